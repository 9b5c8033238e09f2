"""Token counts: unigram segmentation by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words (runs of anything but white space), each
with a leading word mark.  The distinct pre-tokens of a slice are put in order,
which makes their common prefixes a trie; level by level, the best forward score
of each prefix is computed once and shared by all pre-tokens below it.  The score
at a pre-token's end holds its token count, which is then counted for every
place where it stands.

Scores are a fixed vocabulary's: a piece of frequency rank r costs the negative
logarithm of its share under Zipf's law, as an integer; a character that no piece
has costs its UTF-8 bytes.  Of equal costs the fewer tokens win, so counts are
exact and repeatable.

Edge cases: a null or empty text has no tokens; a pre-token of any length is
segmented whole; repeated rows are counted each; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T

MARK = "▁"
LEVELS = 40  # longer pre-tokens get a plain pass of their own
_STEP = 20  # a cost is kept above this many bits of token count
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary by falling frequency, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Costs by piece, and by piece hash for whole arrays.  A fixed table: its size is the vocabulary's."""

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
        self.cost = {p: (round(1e4 * (math.log(r + 2) + total)) << _STEP) + 1 for r, p in reversed(list(enumerate(pieces)))}
        self.byte = (round(1e4 * (math.log(len(pieces) + 2) + total)) << _STEP) + 1
        self.longest = max(map(len, self.cost), default=1)
        keys = np.array([self._hash(p) for p in self.cost], dtype=_U)
        order = np.argsort(keys)
        self.keys, self.costs = keys[order], np.array(list(self.cost.values()), dtype=np.int64)[order]
        self.seen = np.zeros(1 << 21, dtype=bool)
        self.seen[(T.mix(self.keys) >> _U(43)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        x = 0
        for c in piece:
            x = (x * int(_B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return x

    def plain(self, word: str) -> int:
        """Token count of one pre-token, by one forward pass."""
        best = [0]
        for j in range(1, len(word) + 1):
            c = best[j - 1] + self.byte * len(word[j - 1].encode("utf-8", "surrogatepass"))
            for k in range(max(0, j - self.longest), j):
                if (p := self.cost.get(word[k:j])) is not None and best[k] + p < c:
                    c = best[k] + p
            best.append(c)
        return best[-1] & ((1 << _STEP) - 1) if len(word) < 200_000 else self._long(word)

    def _long(self, word: str) -> int:
        """As plain, with the token count beside the cost, for pre-tokens that could overflow its bits."""
        best = [(0, 0)]
        for j in range(1, len(word) + 1):
            n = len(word[j - 1].encode("utf-8", "surrogatepass"))
            c = (best[j - 1][0] + (self.byte >> _STEP) * n, best[j - 1][1] + n)
            for k in range(max(0, j - self.longest), j):
                if (p := self.cost.get(word[k:j])) is not None:
                    c = min(c, (best[k][0] + (p >> _STEP), best[k][1] + 1))
            best.append(c)
            if j > self.longest:
                best[j - self.longest - 1] = (0, 0)
        return best[-1][1]

    def _lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of h that are pieces, their costs)."""
        on = np.flatnonzero(self.seen[(T.mix(h) >> _U(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[on]), len(self.keys) - 1)
        hit = self.keys[at] == h[on]
        return on[hit], self.costs[at[hit]]

    def counts(self, words: list[str]) -> np.ndarray:
        """Token counts of pre-tokens; words must be sorted, so that shared prefixes are neighbours."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        for i in np.flatnonzero(lens > LEVELS).tolist():
            out[i] = self.plain(words[i])
        short = np.flatnonzero(lens <= LEVELS)
        if not len(short):
            return out
        lens = lens[short]
        flat = np.frombuffer("".join(words[i] for i in short.tolist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(lens) - lens
        top, n = int(lens.max()), len(short)
        prefix = np.zeros((top + 1, n), dtype=_U)
        best = np.zeros((top + 1, n), dtype=np.int64)
        powers = np.full(self.longest + 1, _B, dtype=_U)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        for j in range(1, top + 1):
            live = np.flatnonzero(lens >= j)
            c = flat[starts[live] + j - 1].astype(np.int64)
            prefix[j, live] = prefix[j - 1, live] * _B + c.astype(_U) + _U(1)
            new = np.ones(len(live), dtype=bool)
            new[1:] = (prefix[j, live[1:]] != prefix[j, live[:-1]]) | (live[1:] != live[:-1] + 1)
            node, c = live[new], c[new]
            score = best[j - 1, node] + self.byte * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            for k in range(1, min(j, self.longest) + 1):
                at, cost = self._lookup(prefix[j, node] - prefix[j - k, node] * powers[k])
                score[at] = np.minimum(score[at], best[j - k, node[at]] + cost)
            best[j, live] = score[np.cumsum(new) - 1]
        out[short] = best[lens, np.arange(n)] & ((1 << _STEP) - 1)
        return out


def count_column(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of each row."""
    t = T.tokenize(column)
    _, at, inverse = np.unique(t.hashes(), return_index=True, return_inverse=True)
    raw, starts, ends = t.data.tobytes(), t.starts[at].tolist(), t.ends[at].tolist()
    words = [MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
    order = sorted(range(len(words)), key=words.__getitem__)
    counts = np.zeros(len(words), dtype=np.int64)
    counts[order] = vocabulary.counts([words[i] for i in order])
    return t.counts, np.bincount(t.row, weights=counts[inverse], minlength=t.rows).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens) of every document, in one pass without a shuffle.

    vocabulary: path of a sentencepiece vocabulary, read on the driver only; its
    pieces (tens of thousands, a fixed table) go to the tasks with the code.
    """
    pieces = load_pieces(vocabulary or default_vocabulary())

    def run(batches):
        table = Vocabulary(pieces)
        for batch in batches:
            for part in T.slices(batch):
                words, tokens = count_column(part.column("text"), table)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["k", "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"k {kind}, n_words long, n_tokens long")
    return found.withColumnRenamed("k", key)
