"""Text functions as columns: words, keywords, entities, tags, mirror lines, snippets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = tuple(
    "a an the and or but in on at to for of with by from is was are were be been being have has had do does did will would could should may might "
    "shall can that this these those it its as if not no so yet both either neither each all any few more most other such than then just how what "
    "when where who which their there here i we you he she they me him her us them my your his our also into up out about over after before between "
    "through during within without against across along among around behind below beside beyond inside outside since until upon above".split()
)

_FOLD = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and d[0].isalpha()]
_ACCENTED, _PLAIN = "".join(a for a, _ in _FOLD), "".join(b for _, b in _FOLD)


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.lower(F.translate(F.lower(c), _ACCENTED, _PLAIN))


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits of the folded text; an underscore separates."""
    return F.filter(F.split(F.coalesce(fold(c), F.lit("")), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fold_text(s: str) -> str:
    return s.lower().translate(dict(zip(map(ord, _ACCENTED), _PLAIN, strict=True))).lower()


def keywords(c: Column) -> Column:
    """Distinct words of three or more a-z, stopwords left out, in order of first use."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\p{M}]+")
    long = [w for w in STOPWORDS if len(w) > 2]
    return F.array_distinct(F.filter(words, lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*long)))


def entities(c: Column) -> Column:
    """Distinct runs of capitalised words, in order of first use."""
    word = r"[A-Z][a-zA-Z]+"
    edge = r"[\p{L}\p{N}_\p{M}]"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?<!{edge})({word}(?:\s+{word})*)(?!{edge})"), F.lit(1)))


def tags(entity: Column, keyword: Column, n: int = 5) -> Column:
    """The first n distinct lower-cased entities and keywords; null if there are none."""
    found = F.slice(F.array_distinct(F.transform(F.concat(entity, keyword), F.lower)), 1, n)
    return F.when(F.size(found) > 0, found)


def snippet(c: Column, n: int = 160) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "…").otherwise(""))


def category(c: Column) -> Column:
    """A safe file name stem: trimmed, lower-cased, only a-z 0-9 _ -, 64 characters; else notes."""
    s = F.substring(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_-]", ""), 1, 64)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("notes"))


def mirror_line(c: Column) -> Column:
    """One bullet: line ends flattened, comment openers defused."""
    return F.concat(F.lit("- "), F.replace(F.regexp_replace(c, r"\r\n|\r|\n", " "), F.lit("<!--"), F.lit("<!- -")))


def one_line(c: Column) -> Column:
    """Text from elsewhere, safe on a line of markdown."""
    s = F.regexp_replace(c, r"[\r\n]", " ")
    return F.when(s.startswith("#"), F.concat(F.lit(" "), s)).otherwise(s)
