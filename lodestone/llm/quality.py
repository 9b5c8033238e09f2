"""Quality rules: fixed text statistics, and a calibrated logistic regression on hashed n-grams.

Statistics of a whole text (words are runs of anything but white space):
n_words, word_chars, n_symbols (#*$%&|<>), n_dup_lines (lines with a word that
equal an earlier line), n_repeat_words (words in 3-word windows that occur twice
or more).  base_failed: fewer than 50 words, or more than half of the words in
repeated windows.

The model's features are hashed words, hashed pairs of words and hashed runs of 1
to 3 characters, as shares of a text's words, pairs and runs; a logistic regression
is fitted on at most max_train labelled rows of at most about max_bytes of text
(documented bounds), calibrated by Platt scaling on rows held back from it, and
scored in Arrow batches against a fixed threshold.

Edge cases: ids may be of any type; a null text is an empty one (all statistics 0, base_failed); null or
absent labels aren't learnt from, repeated ones count as their largest; without
both classes the probability is the share of label 1; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T
from lodestone.llm.linear import Rows, collect_rows, fit_logistic, labelled_sample, platt, sampled, sigmoid
from lodestone.scratch import Cuts

WORD_BITS, CHAR_BITS, SIZES, SEED = 17, 16, (1, 2, 3), 9
WIDTH, SCALE = (1 << WORD_BITS) + (1 << CHAR_BITS), 20.0
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
THRESHOLD = 0.5


def _duplicates(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal (row, value) together, the first occurrence first, and where a new group begins."""
    order = np.lexsort((np.arange(len(row)), value, row))
    new = np.ones(len(row), dtype=bool)
    a, b = row[order], value[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def text_statistics(column: pa.Array) -> tuple[T.Tokens, np.ndarray, dict[str, np.ndarray]]:
    """(words, their hashes, statistics by name), for each row."""
    t = T.tokenize(column)
    h, rows = t.hashes(), t.rows
    lead = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    per_row = lambda x: np.bincount(t.row, weights=x, minlength=rows).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[t.data])])
    # lines: the bytes between newlines and row ends
    cut = np.flatnonzero(t.data == 10)
    if len(cut):  # a line's row: that of its start, a newline belonging to the row it stands in
        both = np.concatenate([np.stack([t.offsets[:-1], np.arange(rows)], 1), np.stack([cut + 1, np.searchsorted(t.offsets, cut, side="right") - 1], 1)])
        both = both[np.lexsort((both[:, 0], both[:, 1]))]
        starts, owner = both[:, 0], both[:, 1]
    else:
        starts, owner = t.offsets[:-1], np.arange(rows)
    ends = np.empty_like(starts)
    ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:] - 1, t.offsets[owner[:-1] + 1])
    ends[-1:] = t.offsets[-1]
    words_before = np.concatenate([[0], np.cumsum(np.bincount(t.starts, minlength=len(t.data)))])
    full = words_before[ends] > words_before[starts]
    starts, ends, owner = starts[full], ends[full], owner[full]
    order, new = _duplicates(owner, T.hash_ranges(t.data, starts, ends))
    dup_lines = np.bincount(owner[order][~new], minlength=rows)
    # words in repeated windows of three
    at = t.windows(3)
    m = T.multipliers(3, 23)
    tri = T.mix(h[at] * m[0] + h[at + 1] * m[1] + h[at + 2] * m[2]) if len(at) else np.zeros(0, np.uint64)
    order, new = _duplicates(t.row[at], tri)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    twice = at[order][np.repeat(size > 1, size)]
    covered = np.zeros(len(h), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    stats = {"n_words": t.counts, "word_chars": per_row(lead[t.ends] - lead[t.starts]), "n_symbols": np.diff(symbols[t.offsets]), "n_dup_lines": dup_lines, "n_repeat_words": per_row(covered)}
    return t, h, {k: v.astype(np.int64) for k, v in stats.items()}


def _buckets(column: pa.Array, t: T.Tokens, h: np.ndarray):
    """Yields (row, column, SCALE / number of such runs in the row) of words, of word pairs, then of characters."""
    yield t.row, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), np.repeat(SCALE / np.maximum(t.counts, 1), t.counts)
    at, m = t.windows(2), T.multipliers(2, SEED)
    pairs = T.mix(h[at] * m[0] + h[at + 1] * m[1])
    yield t.row[at], (pairs >> np.uint64(64 - WORD_BITS)).astype(np.int64), SCALE / np.maximum(t.counts[t.row[at]] - 1, 1)
    points, offsets = T.code_points(column.to_pylist())
    lens = np.diff(offsets)
    of, share = np.repeat(np.arange(len(lens)), lens), np.repeat(SCALE / np.maximum(lens, 1), lens)
    for at, bucket in T.char_ngrams(points, offsets, SIZES, CHAR_BITS, SEED):
        yield of[at], bucket + (1 << WORD_BITS), share[at]


def _features(column: pa.Array):
    t = T.tokenize(column)
    parts = list(_buckets(column, t, t.hashes()))
    row, col, val = (np.concatenate([p[i] for p in parts]) for i in range(3))
    key, inverse = np.unique(row.astype(np.int64) << 32 | col, return_inverse=True)
    return key & 0xFFFFFFFF, np.bincount(inverse, weights=val, minlength=len(key)), np.searchsorted(key >> 32, np.arange(t.rows + 1))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 4000, max_bytes: int = 50_000_000, l2: float = 1e-4) -> dict:
    """Weights by column, and the calibration: probability = sigmoid(a * z + b)."""
    cuts = Cuts(docs.sparkSession)
    x, y = collect_rows(sampled(docs, key, text, labelled_sample(labels, key, label, None, max_train), max_bytes, cuts), _features)
    cuts.drop_all()
    pos = float(y.sum())
    if pos == 0 or pos == len(y):
        return {"weights": np.zeros(WIDTH, np.float32), "intercept": 0.0, "a": 1.0, "b": float(np.log((pos + 0.5) / (len(y) - pos + 0.5)))}
    back = np.arange(len(y)) % 4 == 3
    w, c = fit_logistic(x.take(~back), y[~back], WIDTH, l2)
    a, b = platt(x.take(back).dot(w) + c, y[back]) if 0 < y[back].sum() < back.sum() else (1.0, 0.0)
    return {"weights": w.astype(np.float32), "intercept": c, "a": a, "b": b}


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """(key, statistics, base_failed, probability, kept) of every document, in one pass without a shuffle."""
    model = fit_quality(docs, labels, key, text, label, **fit)

    def run(batches):
        w = model["weights"]
        for batch in batches:
            for part in T.slices(batch):
                column = part.column("text")
                t, h, stats = text_statistics(column)
                z = np.full(t.rows, model["intercept"])
                for row, col, val in _buckets(column, t, h):
                    z += np.bincount(row, weights=w[col] * val, minlength=t.rows)
                p = np.round(sigmoid(model["a"] * z + model["b"]), 12)
                failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
                yield pa.RecordBatch.from_pydict({"k": part.column("k"), **{n: pa.array(v) for n, v in stats.items()}, "base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= threshold))})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"k {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    )
    return out.withColumnRenamed("k", key)
