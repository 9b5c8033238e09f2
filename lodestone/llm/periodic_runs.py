"""Periodic runs of words, from Lyndon arrays over an ordered alphabet.

A run is a stretch of words with smallest period q that no neighbour extends.  In a
run the least rotation of its period, for the order of words or its reverse, is the
longest Lyndon word where it begins, so that every run appears among the edges from
a position to its next smaller suffix.  Those edges are found from left to right with
how far both ends match (after Ellert and Fischer, 2021): a match is taken over from
the edges before it, by the order of three suffixes or from the copy that the match
reaching farthest has shown, and words are compared only beyond what any match has
reached.  Words are only ever compared; there is no suffix structure and no hash.

Words that can't be in a run of the wanted length and exponent are cut out first (a
run holds each of its words, and each of its windows of four, again); what is left
falls into stretches, and no run crosses from one to another.

Edge cases: a null or empty text has no words and no runs; repeated rows are looked
at each; an empty table gives no rows; a text of any length is looked at whole, in
memory that grows with it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T

MIN_LENGTH, MIN_EXPONENT = 6, 4
_GRAM = 4


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int]]:
    """(next smaller suffix of each position, how many places both match); the end of t is smaller than any word."""
    n = len(t)
    nss, far = [n] * n, [0] * n
    pss, back = [-1] * n, [0] * n  # the last smaller suffix before, and its match
    right, end, shift = 0, 0, 0  # t[right:end] is t[right - shift:end - shift], and no match reaches beyond end
    for r in range(1, n):
        l, of, e = r - 1, -1, 0
        while True:
            k, exact = 0, False
            if of >= 0:  # l is the suffix before of: two matches that differ give the third
                f = back[of]
                k, exact = (e, False) if e == f else (min(e, f), True)
            if not exact:
                if right < r and r + k < end:
                    a, b = (l - shift if l >= right else l), r - shift
                    v = far[a] if nss[a] == b else back[b] if pss[b] == a else k
                    if r + v >= end:
                        k = end - r
                    else:
                        k, exact = v, nss[a] == b or pss[b] == a
                if not exact:
                    while r + k < n and t[l + k] == t[r + k]:
                        k += 1
            if r + k >= end:
                right, end, shift = r, r + k, r - l
            if r + k < n and t[r + k] > t[l + k]:
                pss[r], back[r] = l, k
                break
            nss[l], far[l] = r, k
            of, e, l = l, k, pss[l]
            if l < 0:
                break
    return nss, far


def runs_of(t: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run with length >= max(min_length, min_exponent * period), by start and period."""
    found = set()
    for s in (t, [-x for x in t]):
        nss, far = lyndon_edges(s)
        for i, j in enumerate(nss):
            p = j - i
            # from the first root of a run that is long enough, more than all but one of its periods are to the right
            if far[i] <= (min_exponent - 2) * p or j == len(t):
                continue
            if i >= p and nss[i - p] == i and i + far[i - p] == j + far[i]:  # not the first root
                continue
            start = i
            while start and t[start - 1] == t[start - 1 + p]:  # fewer than p places
                start -= 1
            length = j + far[i] - start
            if length >= max(min_length, min_exponent * p):
                found.add((start, length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def word_ranks(t: T.Tokens) -> np.ndarray:
    """A number for each word, equal for equal words: its rank by length and then by its bytes, eight at a time."""
    sizes = (t.ends - t.starts).astype(np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64)
    padded = np.zeros(len(t.data) + 8, dtype=np.uint8)
    padded[: len(t.data)] = t.data
    eight = np.ndarray(shape=(len(t.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths, rank = np.unique(sizes, return_inverse=True)
    live, at, left = np.arange(len(sizes)), t.starts, sizes
    while len(live):
        word = eight[at]
        short = left < 8
        word[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        kinds, block = np.unique(word, return_inverse=True)
        rank[live] = np.unique(rank[live] * len(kinds) + block, return_inverse=True)[1]
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    # words of one length were ranked together to their ends
    return np.unique(np.searchsorted(lengths, sizes) * (int(rank.max()) + 1) + rank, return_inverse=True)[1]


def _stretches(alive: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of at least so many living words of one row."""
    n = len(alive)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = row[1:] == row[:-1]
    starts = np.flatnonzero(alive & ~(same[:n] & np.concatenate([[False], alive[:-1]])))
    ends = np.flatnonzero(alive & ~(same[1:] & np.concatenate([alive[1:], [False]]))) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _often(key: np.ndarray, least: int) -> np.ndarray:
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] >= least


def possible(word: np.ndarray, row: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches outside which no word is in a run.

    A word of a run is there min_exponent times at least.  Of a run's windows of
    four words each is there twice: there are length - 3 of them in q kinds, and
    that is 2 * q or more (for exponents from 4 and lengths from 5 on).
    """
    if not len(word):
        return _stretches(np.zeros(0, bool), row, min_length)
    least, kinds = max(min_length, min_exponent), int(word.max()) + 1
    starts, ends = _stretches(_often(row.astype(np.int64) * kinds + word, min_exponent), row, least)
    if min_exponent < 4 or least < 5 or not len(starts):
        return starts, ends
    sizes = ends - starts
    part = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(part)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    w = word[at]
    two = np.unique(w[:-1] * np.int64(kinds) + w[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * np.int64(two.max() + 1) + two[2:], return_inverse=True)[1]
    whole = np.flatnonzero(part[: 1 - _GRAM] == part[_GRAM - 1 :])
    again = whole[_often(part[whole].astype(np.int64) * (int(four.max()) + 1) + four[whole], 2)]
    alive = np.zeros(len(word), dtype=bool)
    for k in range(_GRAM):
        alive[at[again + k]] = True
    return _stretches(alive, row, least)


def _kept_text(t: T.Tokens, kept: np.ndarray, r: int) -> str:
    """The kept words of row r, joined by one space; words that stand so in the text are copied together."""
    lo, hi = int(t.first[r]), int(t.first[r + 1])
    at = np.flatnonzero(kept[lo:hi]) + lo
    if not len(at):
        return ""
    joined = (at[1:] == at[:-1] + 1) & (t.starts[at[1:]] == t.ends[at[:-1]] + 1)
    joined[joined] = t.data[t.ends[at[:-1][joined]]] == 0x20
    cut = np.flatnonzero(~joined)
    begins, stops = t.starts[at[np.concatenate([[0], cut + 1])]], t.ends[at[np.concatenate([cut, [len(at) - 1]])]]
    return b" ".join(t.data[a:b].tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)).decode("utf-8", "replace")


def scan_column(column: pa.Array, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, list[list[dict]], list[str]]:
    """(words, runs, text without what repeats) of each row."""
    t = T.tokenize(column)
    word = word_ranks(t)
    runs: list[list[dict]] = [[] for _ in range(t.rows)]
    kept = np.ones(len(word), dtype=bool)
    starts, ends = possible(word, t.row, min_length, min_exponent)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        r = int(t.row[a])
        base = int(t.first[r])
        for start, length, period in runs_of(word[a:b].tolist(), min_length, min_exponent):
            runs[r].append({"start": a - base + start, "length": length, "period": period})
            kept[a + start + period : a + start + length] = False
    return t.counts, runs, [_kept_text(t, kept, r) for r in range(t.rows)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(key, n_words, runs, collapsed) of every document, in one pass without a shuffle.

    runs: array of (start, length, period) by start and period.  collapsed: the words
    that no run repeats (those of its first period stay), joined by one space.
    """
    if min_exponent < 2:
        raise ValueError("a run has an exponent of 2 at least")

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                words, runs, left = scan_column(part.column("text"), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(words, pa.int64()), pa.array(runs, _RUNS), pa.array(left, pa.string())], ["k", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"k {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("k", key)


def with_periodic_tail(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): in a tenth of the documents (by h = crc32 of the key) the words from the a-th on repeat p of them.

    With g = h / 10, a is g % n of n words and p is 1 + (n - a) / (3 + g % 8), divided whole.  A null key changes nothing.
    """
    t = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    n, g = F.size("w").cast("long"), F.expr("h div 10")

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    changes = (F.col("h") % 10 == 0) & F.coalesce(F.col("t").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    t = t.withColumn("w", F.when(changes, F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    t = t.withColumn("a", g % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return t.select(F.col("k").alias(key), F.when(F.col("w").isNotNull(), tail).otherwise(F.col("t")).alias(text))


def run_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli of the run of greatest exponent, runs_sha256, collapsed_sha256) of find_runs."""
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    t = found.withColumn("best", best)
    return t.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
