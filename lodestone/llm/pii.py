"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and not overlapping
within a kind; a match that fails its test is dropped.  Beyond them the method proposes

    card_part  card numbers that the base pattern missed, as they stand in a longer row of digits
    iban       account numbers, confirmed by mod 97
    ssn        social security numbers that may have been given
    local      telephone numbers without a country's prefix
    ip6        addresses of eight groups

Each proposal starts with its pattern's prior; a checksum that holds adds to it and one
that fails ends it; a word of its kind within 40 characters before or 20 after adds to
it, a word that speaks of another kind of number takes away.  Proposals that reach the
threshold and overlap no base span become spans.  Base spans are always kept; they are
scored in the same way.

Spans count code points from 0, end exclusive.

Edge cases: a null text is an empty one, without spans; repeated rows are looked at each;
an empty table gives no rows; a text of any length is looked at whole, in time that grows
with it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "card_part", "iban", "ssn", "local", "ip6")
THRESHOLD = 0.5
BEFORE, AFTER = 40, 20


@dataclass(frozen=True)
class Rule:
    """How a kind is scored: prior, gain of a checksum, and the words that speak for it (within 40 characters before, 20 after)."""

    prior: float
    checksum: float
    words: str


CONTEXT, AGAINST = 0.3, -0.3
#: fixed values: the words, in small letters
RULES = {
    "email": Rule(0.9, 0.0, "e-?mail|mail|contact|kontakt|correo|courriel"),
    "ip": Rule(0.6, 0.0, "ip|host|server|address|client"),
    "card": Rule(0.3, 0.4, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"),
    "phone": Rule(0.6, 0.0, "phone|tel|telefon|call|mobile|fax|cell|whatsapp"),
    "card_part": Rule(0.2, 0.4, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"),
    "iban": Rule(0.2, 0.6, "iban|account|bank|konto|compte|cuenta"),
    "ssn": Rule(0.3, 0.0, "ssn|social|security|tax"),
    "local": Rule(0.25, 0.0, "phone|tel|telefon|call|mobile|fax|cell|whatsapp"),
    "ip6": Rule(0.6, 0.0, "ip|ipv6|host|server|address|client"),
}
#: fixed value: words of numbers that are no personal data
OTHER = "isbn|order|invoice|version|serial|ticket|part|item|build"

#: fixed values: the base patterns and the method's own
EMAIL_LOCAL, EMAIL_DOMAIN = "A-Za-z0-9._%+-", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CHAIN = r"[0-9]+(?:\.[0-9]+)*"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_PART = r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{13,19}"
IBAN = r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL = r"\(?[0-9]{3,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}"
IP6 = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
#: fixed values: how long account numbers of a country are
IBAN_SIZES = dict(
    zip(
        "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR VG".split(),
        map(int, "24 23 28 20 28 20 16 22 22 29 21 22 28 24 22 18 28 20 24 18 18 27 22 22 23 18 27 28 21 28 22 23 26 27 30 30 20 28 21 20 20 21 27 24 22 19 27 31 30 18 15 24 28 29 25 29 24 22 24 24 19 24 27 24 26 24".split()),
        strict=True,
    )
)

_AT = re.compile(f"@({EMAIL_DOMAIN})")
_NOT_LOCAL = re.compile(f"[^{EMAIL_LOCAL}]")
_CHAIN, _CARD, _PHONE = re.compile(CHAIN), re.compile(CARD), re.compile(PHONE)
_MORE = {k: re.compile(p) for k, p in (("card_part", CARD_PART), ("iban", IBAN), ("ssn", SSN), ("local", LOCAL), ("ip6", IP6))}
#: characters that, beside a proposal, make it part of something longer
_WIDER = re.compile("[0-9A-Za-z]")
_WORDS = {k: re.compile(rf"(?:^|[^a-z])(?:{r.words})(?:[^a-z]|$)") for k, r in RULES.items()}
_OTHER = re.compile(rf"(?:^|[^a-z])(?:{OTHER})(?:[^a-z]|$)")
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    back = [ord(c) - 48 for c in reversed(number)]
    return (sum(back[::2]) + sum(_DOUBLED[d] for d in back[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether country, check digits and account number, letters as 10 to 35, leave 1."""
    left = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        left = (left * (100 if v > 9 else 10) + v) % 97
    return left == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @: the local part is all that fits before it, back to the last match, so no run is read twice."""
    last = 0
    at = text.find("@")
    while at >= 0:
        begin, tail = at, _AT.match(text, at)
        # back in growing steps to the character that doesn't fit
        step = 64
        while tail and begin > last:
            low = max(last, begin - step)
            outside = [m.end() for m in _NOT_LOCAL.finditer(text, low, begin)]
            if outside:
                begin = outside[-1]
                break
            begin, step = low, step * 2
        if tail and begin < at:
            yield begin, tail.end()
            last = tail.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each four numbers of a chain of numbers and dots, whose parts are at most 255."""
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_byte, four)):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(n := digits(m.group())) <= 19 and luhn(n):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(digits(m.group())) <= 15:
            yield m.span()


def _valid(kind: str, found: str) -> bool:
    """Whether a proposal's checksum, or what its numbers may be, holds."""
    if kind == "card_part":
        return luhn(digits(found)) and found[0] in "3456"
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "ssn":
        return found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
    if kind == "local":
        return 9 <= len(digits(found)) <= 12
    return True


def _account(found: str) -> int:
    """How much of a proposal is as long as the country's accounts are; 0 if it is too short or of no country."""
    size, letters = IBAN_SIZES.get(found[:2], 0), 0
    for i, c in enumerate(found):
        letters += c != " "
        if letters == size:
            return i + 1
    return 0


def _score(kind: str, text: str, s: int, e: int) -> float:
    near = text[max(0, s - BEFORE) : s].translate(_SMALL) + " | " + text[e : e + AFTER].translate(_SMALL)
    r = RULES[kind]
    return round(min(1.0, max(0.0, r.prior + r.checksum + CONTEXT * bool(_WORDS[kind].search(near)) + AGAINST * bool(_OTHER.search(near)))), 6)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    found = []
    numbers = re.search("[0-9]", text) is not None
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if numbers:
        found += [("ip", *x) for x in addresses(text)] + [("card", *x) for x in cards(text)]
    if "+" in text:
        found += [("phone", *x) for x in phones(text)]
    out = [(k, s, e, _score(k, text, s, e)) for k, s, e in found]
    if not numbers:
        return out
    base = sorted((s, e) for _, s, e in found)
    for kind, pattern in _MORE.items():
        b, reach = 0, 0  # base spans that begin before the proposal's end, and how far they go
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "iban":
                e = s + _account(m.group())
            while b < len(base) and base[b][0] < e:
                reach = max(reach, base[b][1])
                b += 1
            if reach > s or (s and _WIDER.match(text, s - 1)) or _WIDER.match(text, e) or e == s or not _valid(kind, text[s:e]):
                continue
            if (score := _score(kind, text, s, e)) >= threshold:
                out.append((kind, s, e, score))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, spans) of every document, in one pass without a shuffle; spans: array of (kind, s, e, score) by kind, then start."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                spans = [[dict(zip(("kind", "s", "e", "score"), x, strict=True)) for x in find_spans(t or "", threshold)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(spans, _SPANS)], ["k", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"k {kind}, spans array<struct<kind:string,s:long,e:long,score:double>>")
    return found.withColumnRenamed("k", key)


def pii_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, a count for each base kind, n_more, base_sha256, spans, scores) of find_pii; scores stand as spans do."""
    of = lambda keep: F.filter("spans", keep)
    base = of(lambda x: x["kind"].isin(*BASE))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def count(kind: str) -> Column:
        return F.size(of(lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *map(count, BASE), (F.size("spans") - F.size(base)).cast("long").alias("n_more"), F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
