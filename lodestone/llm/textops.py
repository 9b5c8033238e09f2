"""Vectorised text primitives shared by the training-data operators.

Everything works on the UTF-8 bytes of one Arrow string column, in slices of a
few megabytes, so that memory is bounded by the slice (or by one text, when a
single text is larger).  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX_A = _U(0xBF58476D1CE4E5B9)
_MIX_B = _U(0x94D049BB133111EB)
_LEN = _U(0xD6E8FEB86659FD93)


def _table(separators: bytes) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: words are runs of anything but space and U+0009..U+000D
SPACED = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: words are runs of a-z, 0-9 and everything outside ASCII (after lower-casing)
ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _MIX_A
    x = x ^ (x >> _U(27))
    x = x * _MIX_B
    return x ^ (x >> _U(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _BASE + _U(seed)) | _U(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Row slices of about limit bytes of text each; one long text stays whole."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


@dataclass
class Tokens:
    """Words of some rows: byte ranges, the row of each, and where each row's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # rows + 1 indices into starts

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)

    def windows(self, n: int) -> np.ndarray:
        """Indices of the words at which n words of one row begin."""
        if len(self.starts) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def tokenize(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False) -> Tokens:
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    inside = table[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)  # a row begins (or the data end) here
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    if n:
        stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    return Tokens(data, offsets, starts, ends, row, first)


#: ranges above so many bytes are hashed one by one
LONG_RANGE = 256


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand.

    A range is read in words of 8 bytes, each mixed into all bits of the state before
    the next, so no regular text makes two ranges meet; long ranges get a BLAKE2 hash.
    """
    if not len(starts):
        return np.zeros(0, dtype=_U)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    # every byte position read as the 8 bytes from there on
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = (ends - starts).astype(np.int64)
    out = sizes.astype(_U) * _LEN + _BASE
    live = np.flatnonzero(sizes <= LONG_RANGE)
    at, left = starts[live], sizes[live]
    while True:
        on = left > 0
        if not on.all():
            live, at, left = live[on], at[on], left[on]
        if not len(live):
            break
        word = eight[at]
        short = left < 8
        if short.any():
            word[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
        out[live] = mix(out[live] ^ word) + _BASE
        at, left = at + 8, left - 8
    for i in np.flatnonzero(sizes > LONG_RANGE).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def shingles(tokens: Tokens, hashes: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of n words; a row of fewer words has one run of all of them."""
    at, m = tokens.windows(n), multipliers(n, 11)
    out = np.zeros(len(at), dtype=_U)
    for k in range(n):
        out += hashes[at + k] * m[k]
    out, row = mix(out), tokens.row[at]
    short = np.flatnonzero((tokens.counts > 0) & (tokens.counts < n))
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for k in range(n - 1):
            has = tokens.counts[short] > k
            extra[has] += hashes[tokens.first[short[has]] + k] * m[k]
        row, out = np.concatenate([row, short.astype(row.dtype)]), np.concatenate([out, mix(extra)])
        order = np.argsort(row, kind="stable")
        row, out = row[order], out[order]
    return row, out


def row_sets(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted: (values, rows + 1 offsets)."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return value, np.searchsorted(row, np.arange(rows + 1))


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets), A-Z lower-cased and white space made a space."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    upper = (points >= 65) & (points <= 90)
    points[upper] += 32
    points[(points >= 9) & (points <= 13)] = 32
    return points, offsets


def char_ngrams(points: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int, seed: int, chunk: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start positions, hashed buckets) of every run of characters in one row, for each size and chunk of characters.

    Chunks bound the memory, whatever the length of a text; a run that crosses into
    the next chunk belongs to the one that it begins in.
    """
    top = max(sizes)
    m = multipliers(top, seed)
    for lo in range(0, len(points), chunk):
        own = min(chunk, len(points) - lo)
        wide = points[lo : lo + own + top - 1].astype(_U) + _U(1)
        place = np.arange(lo, lo + own)
        left = offsets[np.searchsorted(offsets, place, side="right")] - place  # characters of the row from here on
        acc = np.zeros(own, dtype=_U)
        for k in range(top):
            n = min(own, len(wide) - k)
            if n <= 0:
                break
            acc[:n] += wide[k : k + n] * m[k]
            if k + 1 in sizes:
                at = np.flatnonzero(left >= k + 1)
                yield at + lo, (mix(acc[at] + _U(k + 1)) >> _U(64 - bits)).astype(np.int64)
