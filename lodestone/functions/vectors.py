"""Vector columns: dot products, normalisation, packing."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

UNROLLED = 256


def dot_literal(v: Column, query: list[float]) -> Column:
    """Dot product with a fixed vector in doubles; null where the length differs.

    Short vectors are written out term by term, which stays within generated code; a
    higher-order function would be interpreted.
    """
    if len(query) <= UNROLLED:
        total = F.lit(0.0)
        for i, q in enumerate(query):
            total = total + F.get(v, i).cast("double") * F.lit(float(q))
    else:
        total = dot(v, F.array(*[F.lit(float(q)) for q in query]))
    return F.when(F.size(v) == len(query), total)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vector columns in doubles; null where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x))


def normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float"))


def pack_embedding(v: list[float], dim: int) -> bytes:
    if len(v) != dim:
        raise ValueError(f"expected {dim} numbers, got {len(v)}")
    return struct.pack(f"<{dim}f", *v)


@F.pandas_udf(ArrayType(FloatType()))
def unpack_embedding(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null for a length that is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def unpacked(blob: Column, dim: int) -> Column:
    """Vectors of that length; null for any other length."""
    return unpack_embedding(F.when(F.octet_length(blob) == 4 * dim, blob))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: hashed words, unit length."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed_udf(make: Callable[[], Callable[[list[str]], np.ndarray]]):
    """An Arrow-batched embedding function; make() loads the model once a task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model([t or "" for t in texts])))

    return embed


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens, then unit length; hidden states of rank 3, or pooled ones of rank 2."""
    if hidden.ndim == 3:
        m = mask[..., None].astype(np.float32)
        hidden = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    elif hidden.ndim != 2:
        raise ValueError(f"unexpected rank {hidden.ndim}")
    return hidden / np.maximum(np.linalg.norm(hidden, axis=1, keepdims=True), 1e-12)
