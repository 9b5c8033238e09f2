"""Spelling variants: words of a vocabulary one edit apart, and the form that each stands for.

A pigeonhole join.  A word is cut evenly into two segments, whose places hang on its
length; one edit leaves one of them as it is.  A word indexes its own two segments and
probes, in the index of its own length and of one less, the substrings that stand where
an untouched segment would: the first at its place, the second shifted by the difference
in length.  What lies outside the untouched part is a window in which the edit must be.

A segment that very many words share isn't compared all with all: the windows of its
words are cut evenly again, so that they meet by more of their letters, until a group is
small or its window is one letter (then all that meet are near).  A round keeps only
groups in which two words may meet, so that rounds end with the logarithm of the longest
word.  Two words may meet in more than one window only by an insertion beside its own
letter; the window with their first difference counts, which leaves each pair once.
Candidates are verified by their distance.

Edge cases: null and empty texts have no words; repeated rows count again; a null key
deletes nothing; no words or a vocabulary without near words give rows without forms, an
empty table none; a word of any length is taken whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import Cuts

WORDS = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: a group with more candidates than this for each of its words is cut again
CROWD = 8


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = 97, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters, counted; of each that slip divides the crc32 of key:word, one letter is left out."""
    t = docs.select(F.col(key).cast("string").alias("k"), F.explode(F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))).alias("w"))
    word = F.col("w")
    if slip:
        h = F.crc32(F.concat(F.col("k"), F.lit(":"), word).cast("binary"))
        at = (h % F.length(word)).cast("int")
        word = F.when(h % slip == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)
    # combined before the shuffle: a very common word is one row of each task
    return t.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _part(word: Column, a: Column, b: Column) -> Column:
    return F.substr(word, (a + 1).cast("int"), (b - a).cast("int"))


def _halves(views: DataFrame) -> DataFrame:
    """Both halves of each window, with the letters outside as the key to meet by.

    views: word, n, l (length of the index that is asked), more (letters beyond it: 0, or 1 for
    the longer words), kind (0 equal lengths, 1 one longer), window [a, b) in a word of length l.
    """
    m = F.expr("int((a + b) div 2)")
    windows = F.array(F.struct(F.col("a").alias("a"), m.alias("b")), F.struct(m.alias("a"), F.col("b").alias("b")))
    t = views.withColumn("v", F.explode(windows)).select("word", "n", "l", "more", "kind", F.col("v.a").alias("a"), F.col("v.b").alias("b"))
    return t.withColumn("rest", F.concat(_part(F.col("word"), F.lit(0), F.col("a")), F.substr("word", F.col("b") + F.col("more") + 1)))


GROUP = ("kind", "l", "a", "b", "rest")


def near_pairs(words: DataFrame, cuts: Cuts, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words (word, n) that one inserted, deleted or replaced code point parts."""
    l = F.length("word")
    own = lambda kind: F.struct(F.lit(kind).alias("kind"), l.alias("l"), F.lit(0).alias("more"))
    longer = F.struct(F.lit(1).alias("kind"), (l - 1).alias("l"), F.lit(1).alias("more"))
    views = words.where(l > 0).select("word", "n", F.explode(F.array(own(0), own(1), longer)).alias("v")).select("word", "n", "v.*")
    views = views.where("l > 0").withColumn("a", F.lit(0)).withColumn("b", F.col("l"))
    pairs, old = None, None
    while True:
        views = cuts.cut(_halves(views))
        if old is not None:
            cuts.drop(old)
        old = len(cuts.made) - 1
        met = views.groupBy(*GROUP).agg(F.count("*").alias("all"), F.sum("more").alias("longer")).withColumn("own", F.col("all") - F.col("longer"))
        # candidates of a group: own with own, or own with longer ones
        met = met.withColumn("c", F.when(F.col("kind") == 0, F.col("own") * (F.col("own") - 1) / 2).otherwise(F.col("own") * F.col("longer"))).where("c > 0")
        met = met.select(*GROUP, ((F.col("c") > crowd * F.col("all")) & (F.col("b") - F.col("a") > 1)).alias("crowded"))
        views = cuts.cut(views.join(met, [*GROUP]))
        cuts.drop(old)
        old = len(cuts.made) - 1
        left = views.where(~F.col("crowded"))
        x = left.where("more = 0").select(*GROUP, F.col("word").alias("x"), F.col("n").alias("x_n"))
        y = left.where("kind = 0 OR more = 1").select(*GROUP, F.col("word").alias("y"), F.col("n").alias("y_n"))
        found = x.join(y, [*GROUP]).where("kind = 1 OR x < y")
        # an insertion belongs to the window with the first difference, or to the last window
        inside = (F.col("kind") == 0) | (F.col("b") == F.col("l")) | (_part(F.col("x"), F.col("a"), F.col("b")) != _part(F.col("y"), F.col("a"), F.col("b")))
        found = cuts.cut(found.where(inside & (F.levenshtein("x", "y", 1) == 1)).select("x", "x_n", "y", "y_n"))
        pairs = found if pairs is None else pairs.unionAll(found)
        views = views.where("crowded").drop("rest", "crowded")
        if views.isEmpty():
            break
    ends = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    return pairs.select(F.inline(F.array(ends("x", "y"), ends("y", "x"))))


def roots(forms: DataFrame, cuts: Cuts) -> DataFrame:
    """(word, root) for (word, form): the last of the words reached by following forms.

    A form counts more than its word, so there are no circles; each round doubles the
    steps, and only words that have still not reached a root are joined again.
    """
    at = cuts.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(on, "root", "left")
        at = cuts.cut(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is the commonest word near it (ties: the first in code-point order) if that
    occurs ratio times as often; root is where forms lead to.  slip: see vocabulary.
    """
    if ratio <= 1:
        raise ValueError("a form must be commoner than its word")
    cuts = Cuts(docs.sparkSession)
    words = cuts.cut(vocabulary(docs, key, text, slip, min_length, min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, cuts, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    t = words.join(near, "word", "left")
    has = -F.col("best.n") >= ratio * F.col("n")
    t = cuts.cut(t.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")))
    found = roots(t.where("form IS NOT NULL"), cuts)
    return t.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
