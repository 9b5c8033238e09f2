"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed runs of 4 to 7 characters in its
whole text (A-Z lower-cased, white space one kind).  Each feature is scaled by
r = log((p + a) / |p|) - log((q + a) / |q|), p and q its document counts among
toxic and other training rows; features with a small |r| or a small count carry
no weight.  A logistic regression on the scaled features, in which
both classes weigh the same, gives the score.

Fitting uses at most max_train labelled rows of at most about max_bytes of text
(documented bounds), so the model
is a fixed 2**bits table; scoring is one pass over the documents without a
shuffle.

Edge cases: ids may be of any type; a null text is an empty one and scores as the intercept; labels that
are null or whose id is null aren't learnt from; repeated labels of an id count
as their largest; without both classes among the labels every score is the
smoothed share of label 1; an empty table gives no rows; columns other than the
key and the text are ignored here, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T
from lodestone.llm.linear import collect_rows, fit_logistic, held_out, labelled_sample, sampled, sigmoid
from lodestone.scratch import Cuts

BITS, SIZES, SEED = 20, (4, 5, 6, 7), 5
SLICE = 300_000  # bytes of text at once: a text's characters are held several times over, for each size
THRESHOLD = 0.7


def _distinct(texts: pa.Array, table: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(columns, row offsets): each row's distinct columns; table maps a bucket to its column or -1."""
    points, offsets = T.code_points(texts.to_pylist())
    keys = [np.zeros(0, np.int64)]
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for at, bucket in T.char_ngrams(points, offsets, SIZES, bits, SEED):
        column = table[bucket]
        on = column >= 0
        keys.append(np.unique(of[at[on]].astype(np.int64) << 32 | column[on]))
    key = np.unique(np.concatenate(keys))
    return key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(len(offsets)))


def _ngram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, p, n): document counts of each bucket that occurs, among toxic rows and among all."""

    def run(batches):
        # last: the row that had a bucket last, so that a row counts it once, however long its text
        counts, last, rows_before = np.zeros((2, 1 << BITS), dtype=np.int64), np.full(1 << BITS, -1, dtype=np.int64), 0
        for batch in batches:
            for part in T.slices(batch, limit=SLICE):
                points, offsets = T.code_points(part.column("text").to_pylist())
                y = part.column("_y").to_pylist()
                for at, bucket in T.char_ngrams(points, offsets, SIZES, BITS, SEED):
                    ends = np.searchsorted(at, offsets)
                    for i in np.flatnonzero(np.diff(ends)).tolist():
                        new = bucket[ends[i] : ends[i + 1]]
                        new = new[last[new] != rows_before + i]
                        last[new] = rows_before + i
                        # a bucket that stands in new several times is added to once
                        counts[1][new] += 1
                        if y[i] > 0:
                            counts[0][new] += 1
                rows_before += part.num_rows
        on = np.flatnonzero(counts[1])
        for k in range(0, len(on), 100_000):
            at = on[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "p", "n"])

    return rows.mapInArrow(run, "bucket long, p long, n long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _chosen(counts: DataFrame, min_docs: int, min_ratio: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their ratios): only those in enough documents and with a large ratio reach the driver."""
    p, n = (float(x or 0) for x in counts.agg(F.sum("p"), F.sum("n")).first())
    all_p, all_q = p + alpha * (1 << BITS), n - p + alpha * (1 << BITS)
    about = F.log((F.col("p") + alpha) / all_p) - F.log((F.col("n") - F.col("p") + alpha) / all_q)
    # the logarithms of Spark may differ in the last place, so those nearby come too
    found = counts.where((F.col("n") >= min_docs) & (F.abs(about) >= min_ratio - 1e-6)).toArrow().sort_by("bucket")
    p, n = (found.column(c).to_numpy().astype(np.float64) for c in ("p", "n"))
    r = np.log((p + alpha) / all_p) - np.log((n - p + alpha) / all_q)
    on = np.abs(r) >= min_ratio
    return found.column("bucket").to_numpy()[on], r[on]


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, max_train: int = 20_000, max_bytes: int = 200_000_000, min_ratio: float = 2.0, min_docs: int = 4, alpha: float = 1.0, l2: float = 1e-3) -> dict:
    """The model: table (bucket to column or -1), weights (scaled by r), intercept.

    The sampled documents and the counts of their n-grams are written once; only the
    chosen n-grams and features are collected.
    """
    cuts = Cuts(docs.sparkSession)
    rows = sampled(docs, key, text, labelled_sample(labels, key, label, folds, max_train), max_bytes, cuts)
    chosen, r = _chosen(cuts.cut(_ngram_counts(rows)), min_docs, min_ratio, alpha)
    table = np.full(1 << BITS, -1, dtype=np.int32)
    table[chosen] = np.arange(len(chosen))

    def features(column: pa.Array):
        cols, offsets = _distinct(column, table)
        return cols, r[cols], offsets

    x, y = collect_rows(rows, features)
    cuts.drop_all()
    pos = float(y.sum())
    if pos == 0 or pos == len(y):
        table[:] = -1
        return {"table": table, "weights": np.zeros(0), "intercept": float(np.log((pos + 0.5) / (len(y) - pos + 0.5)))}
    w, b = fit_logistic(x, y, len(chosen), l2, balanced=True)
    return {"table": table, "weights": w * r, "intercept": b}


def score_toxicity(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): one row for each document, in one pass without a shuffle."""
    table, weights, intercept = model["table"], model["weights"], model["intercept"]

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, limit=SLICE):
                cols, offsets = _distinct(part.column("text"), table)
                sums = np.concatenate([[0.0], np.cumsum(weights[cols])]) if len(weights) else np.zeros(1)
                z = sums[offsets[1:]] - sums[offsets[:-1]] if len(weights) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(np.round(sigmoid(z + intercept), 12))], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"k {kind}, score double")
    return scored.select(F.col("k").alias(key), "score")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    model = fit_toxicity(docs, labels, key, text, label, folds, **fit)
    scored = score_toxicity(docs, model, key, text)
    return scored.select(key, held_out(key, folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The documents below the threshold, with their own columns; each text is read once and never shuffled."""
    model = fit_toxicity(docs, labels, key, text, **fit)
    table, weights, intercept = model["table"], model["weights"], model["intercept"]
    names, text_at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part in T.slices(batch, f"c{text_at}", SLICE):
                cols, offsets = _distinct(part.column(text_at), table)
                sums = np.concatenate([[0.0], np.cumsum(weights[cols])]) if len(weights) else np.zeros(1)
                z = sums[offsets[1:]] - sums[offsets[:-1]] if len(weights) else np.zeros(part.num_rows)
                yield part.filter(pa.array(np.round(sigmoid(z + intercept), 12) < threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
