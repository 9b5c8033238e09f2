"""Logistic regression on hashed sparse rows, fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T
from lodestone.scratch import Cuts

TASK_BYTES = 4_000_000


class Rows:
    """Sparse rows: for each row a slice of (column, value)."""

    def __init__(self, lens: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.lens, self.cols, self.vals = lens.astype(np.int64), cols.astype(np.int32), vals.astype(np.float32)
        self.of = np.repeat(np.arange(len(lens), dtype=np.int32), self.lens)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.cols] * self.vals, minlength=len(self.lens))

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.of] * self.vals, minlength=width)

    def take(self, rows: np.ndarray) -> Rows:
        keep = np.zeros(len(self.lens), dtype=bool)
        keep[rows] = True
        on = keep[self.of]
        return Rows(self.lens[keep], self.cols[on], self.vals[on])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _loss(x: Rows, y: np.ndarray, c: np.ndarray, v: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    w, b = v[:-1], v[-1]
    z = x.dot(w) + b
    s = np.where(y > 0, z, -z)
    loss = c @ np.logaddexp(0, -s) + 0.5 * l2 * (w @ w)
    g = c * (sigmoid(z) - y)
    return loss, np.append(x.back(g, len(w)) + l2 * w, g.sum())


def fit_logistic(x: Rows, y: np.ndarray, width: int, l2: float = 1e-4, balanced: bool = False, steps: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """L-BFGS with step halving; (weights, intercept).  balanced: both classes weigh the same."""
    v = np.zeros(width + 1)
    c = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum())) if balanced else np.full(len(y), 1 / len(y))
    v[-1] = np.log(((c @ y) + 1e-3) / (c @ (1 - y) + 1e-3))
    loss, g = _loss(x, y, c, v, l2)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * t
        if past:
            s, t, _ = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - r * (t @ d)) * s
        slope, step = g @ d, 1.0 if past else 1 / max(1.0, np.abs(g).sum())
        if slope > -1e-14:
            break
        for _ in range(30):
            new = v + step * d
            new_loss, new_g = _loss(x, y, c, new, l2)
            if new_loss <= loss + 1e-4 * step * slope:
                break
            step /= 2
        s, t = new - v, new_g - g
        if s @ t > 1e-18:
            past = [*past[1 - memory :], (s, t, 1 / (s @ t))]
        done = loss - new_loss < 1e-7 * max(1e-3, abs(loss))
        v, loss, g = new, new_loss, new_g
        if done:
            break
    return v[:-1], float(v[-1])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * z + b) is calibrated on held-back scores (smoothed targets): Newton with step halving."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(z).max(initial=0.0)))
    x = np.stack([z / scale, np.ones(len(z))], 1)
    loss = lambda v: np.logaddexp(0, x @ v).sum() - target @ (x @ v)
    v = np.zeros(2)
    for _ in range(100):
        p = sigmoid(x @ v)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        for _ in range(40):
            if loss(v - step) <= loss(v):
                break
            step /= 2
        v = v - step
        if np.abs(step).max() < 1e-10:
            break
    return float(max(v[0] / scale, 1e-3)), float(v[1])


def held_out(key: str, folds: int):
    """True where crc32 of the id as text leaves 1; an id of null counts as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 1, F.lit(False))


def share(what: str, *columns: str, seed: int, part: int, whole: int):
    """True for about part of whole distinct values of the columns, by a hash that is as fine as the share is small."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 62)) < threshold(part, whole, what)


def threshold(part: int, whole: int, what: str = "rows") -> int:
    found = (1 << 62) * part // whole
    if not found:
        raise ValueError(f"no sample of {part} of {whole} {what}")
    return found


def labelled_sample(labels: DataFrame, key: str, label: str, folds: int | None, limit: int) -> DataFrame:
    """(key, y) of at most about limit learnable ids, chosen by a hash of the id.

    Ids are compared as texts, so they may be of any type.  Repeated labels of one id
    count as their largest; null ids and null labels are left out.
    """
    if folds:
        labels = labels.where(~held_out(key, folds))
    one = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).cast("string").alias("_key"))
        .agg(F.max(F.col(label).cast("int")).alias("_y"))
    )
    total = one.count()
    if total > limit:
        one = one.where(share("labelled ids", "_key", seed=17, part=limit, whole=total))
        if one.isEmpty():
            raise ValueError(f"a sample of {limit} of {total} labelled ids is empty")
    return one


def sampled(docs: DataFrame, key: str, text: str, sample: DataFrame, max_bytes: int, cuts: Cuts) -> DataFrame:
    """The sampled documents as (_key, text, _y), written once.

    Where their texts exceed max_bytes a share of the distinct ones is taken, by a hash
    of id and text.  sample is bounded (labelled_sample), so the join is a broadcast of
    that bounded table.  It is read by tasks of about TASK_BYTES.
    """
    rows = cuts.cut(docs.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "_key"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > max_bytes:
        rows = rows.where(share("bytes of labelled texts", "_key", "text", seed=18, part=max_bytes, whole=total)).dropDuplicates(["_key", "text"])
        if rows.isEmpty():
            raise ValueError(f"a sample of {max_bytes} of {total} bytes of labelled texts is empty")
    # the sample is as small whatever the documents' size: its tasks are as many as its bytes ask for
    return rows.coalesce(min(total, max_bytes) // TASK_BYTES + 1)


def collect_rows(rows: DataFrame, features) -> tuple[Rows, np.ndarray]:
    """Sparse features of sampled documents, in a fixed order, on the driver: bounded as the sample is.

    features(column) gives (columns, values, row offsets).
    """

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                cols, vals, offsets = features(part.column("text"))
                bits = offsets.tolist()
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("_key"),
                    "y": part.column("_y"),
                    "cols": pa.array([cols[a:b].astype(np.int32).tobytes() for a, b in zip(bits, bits[1:], strict=False)], pa.binary()),
                    "vals": pa.array([vals[a:b].astype(np.float32).tobytes() for a, b in zip(bits, bits[1:], strict=False)], pa.binary()),
                })

    found = rows.mapInArrow(run, "id string, y int, cols binary, vals binary").collect()
    found.sort(key=lambda r: (r.id, bytes(r.cols)))
    cols = [np.frombuffer(r.cols, np.int32) for r in found]
    vals = [np.frombuffer(r.vals, np.float32) for r in found]
    lens = np.array([len(c) for c in cols], dtype=np.int64)
    empty = np.zeros(0)
    return Rows(lens, np.concatenate([*cols, empty]), np.concatenate([*vals, empty])), np.array([r.y for r in found], dtype=np.float64)
