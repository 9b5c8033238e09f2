"""LM scoring: a trigram model as a weighted backoff automaton, one traversal per text.

The model has Dirichlet smoothing from each order to the one below:

    P(w)       = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    P(w | v)   = (c(v w) + m2 * P(w)) / (c(v) + m2)
    P(w | u v) = (c(u v w) + m3 * P(w | v)) / (c(u v) + m3)

which is normalised for every context.  As an automaton: a root state, whose arcs
are the words with P(w); a state for each word seen (and the beginning of a text),
with an arc for each bigram seen and a failure arc to the root weighing
m2 / (c(v) + m2); a state for each bigram seen, with an arc for each trigram seen and
a failure arc to its last word's state weighing m3 / (c(u v) + m3).  Reading a word
follows failure arcs until a state has an arc for it; the arc leads to the state of
the longest suffix that is a state.  A text is read once from left to right,
carrying the state and adding up the arcs' logarithms (Automaton.traverse).

No automaton of the whole corpus is ever built in one place.  Texts are dealt into
blocks of a bounded size.  A block asks for the corpus counts of its n-grams in three
rounds, words, bigrams, trigrams: an n-gram is asked for only if its parts occur in
other blocks too, since otherwise no other block can have it and the block's own
count is all there is.  Requests carry the block's own training counts, so a
frequent n-gram is pre-aggregated, and go to buckets of the key space, which add the
counts up and answer with the sum where several blocks asked.  With more than FAN buckets requests go through a level between: groups of
blocks merge theirs, ask the buckets and hand the answers down, so that neither a
bucket hears of all blocks nor a block of all buckets.  A block then compiles the
part of the automaton that its texts can reach and traverses them.  Words are asked
for by hashes of 64 bits.  Those that several blocks have get numbers in the answers,
which are near dense, so that a bigram of two such words (no others are asked for) is
the exact pair of their numbers in few bits, and a trigram the exact triple where three
numbers fit into 64 bits, else a hash of that width.  Keys are shuffled as packed arrays.

Edge cases: a null text is an empty one, whose only token is the end; texts whose
id is null are learnt from and not held out; repeated rows count each; keys may be
of any type; without training tokens N and V are 0 and P(w) is 1; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T
from lodestone.llm.linear import held_out

#: m2 and m3
PRIORS = (300.0, 10.0)
BLOCK_BYTES, BUCKET_BYTES, FAN = 6_000_000, 2_000_000, 4096
MERGED_BYTES = 64_000_000
_U = np.uint64
_END = _U(0x0123456789ABCDEF)
_BEGIN = _U(0xFEDCBA9876543210)


_HEAD = np.dtype([("n", "<u4"), ("base", "<u8"), ("zeros", "u1"), ("low", "u1")])


def pack(keys: np.ndarray) -> bytes:
    """Distinct sorted 64-bit keys in half a bit a key more than their differences need (an Elias-Fano code).

    What is above the least, without the zeros that all end with: low bits as they are
    (whole bytes as planes), high ones as the places of ones among the steps between.
    """
    if not len(keys):
        return b""
    above = keys - keys[0]
    every = int(np.bitwise_or.reduce(above))
    zeros = (every & -every).bit_length() - 1 if every else 0
    above >>= _U(zeros)
    low = max(0, (int(above[-1]) // len(keys)).bit_length() - 1)
    head, parts = np.array([(len(keys), keys[0], zeros, low)], dtype=_HEAD), []
    if low >= 8:
        parts.append(above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : low // 8].T.tobytes())
    if low % 8:
        rest = (above >> _U(low // 8 * 8)).astype(np.uint8)[:, None]
        parts.append(np.packbits(np.unpackbits(rest, axis=1)[:, 8 - low % 8 :]).tobytes())
    at = (above >> _U(low)).astype(np.int64) + np.arange(len(keys))
    steps = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
    steps[at] = 1
    return b"".join([head.tobytes(), *parts, np.packbits(steps).tobytes()])


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, _U)
    n, base, zeros, low = np.frombuffer(raw, dtype=_HEAD, count=1)[0].item()
    data, planes, odd = np.frombuffer(raw, dtype=np.uint8, offset=_HEAD.itemsize), low // 8, low % 8
    odd_bytes = -(-n * odd // 8)
    steps = data[planes * n + odd_bytes :]
    above = (np.flatnonzero(np.unpackbits(steps)) - np.arange(n)).astype(_U) << _U(low)
    if planes:
        whole = np.zeros((n, 8), dtype=np.uint8)
        whole[:, :planes] = data[: planes * n].reshape(planes, n).T
        above |= whole.view("<u8").ravel()
    if odd:
        bits = np.zeros((n, 8), dtype=np.uint8)
        bits[:, 8 - odd :] = np.unpackbits(data[planes * n : planes * n + odd_bytes], count=n * odd).reshape(n, odd)
        above |= np.packbits(bits, axis=1).ravel().astype(_U) << _U(8 * planes)
    return (above << _U(zeros)) + _U(base)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them all, as byte planes, deflated: most of them are small."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def pack_places(places: np.ndarray) -> bytes:
    """Increasing places (numbered) by their differences."""
    return pack_counts(np.diff(places, prepend=0))


@dataclass(frozen=True)
class Numbers:
    """The numbers of words: places are those of a block's words that several blocks have, a bucket's rank beside the
    bucket's number (numbered); a bucket gives at most stride of them."""

    places: np.ndarray
    buckets: int
    stride: int

    def bits(self) -> int:
        """Of a word's number; the greatest is that of the beginning."""
        return max(1, (self.buckets * self.stride).bit_length())

    def of(self, elsewhere: np.ndarray) -> np.ndarray:
        """By word, and last for the beginning; of no meaning where elsewhere is false."""
        out = np.zeros(len(elsewhere), dtype=_U)
        out[-1] = self.buckets * self.stride
        out[:-1][elsewhere[:-1]] = (self.places >> 32) * self.stride + (self.places & 0xFFFFFFFF)
        return out


def spread(code: np.ndarray, bits: int) -> np.ndarray:
    """Codes of so many bits, each another key: a one-to-one mix, moved to the top of 64 bits, where buckets look."""
    most = _U((1 << bits) - 1)
    code = code * _U(0x9E3779B97F4A7C15) & most
    code ^= code >> _U((bits + 1) // 2)
    return (code * _U(0xBF58476D1CE4E5B9) & most) << _U(64 - bits)


@dataclass
class Grams:
    """Distinct n-grams of a block: their keys, own training counts, and the two (n-1)-grams that each is made of."""

    keys: np.ndarray
    own: np.ndarray
    at: np.ndarray  # for each token the n-gram that ends in it; -1: none
    left: np.ndarray
    right: np.ndarray

    def ask(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, own counts doubled, place of each wanted n-gram among them)."""
        keys, place = np.unique(self.keys[wanted], return_inverse=True)
        return keys, np.bincount(place, weights=self.own[wanted], minlength=len(keys)).astype(np.int64) * 2, place


class Block:
    """The token sequences of a block's texts, and their words, bigrams and trigrams."""

    def __init__(self, table: pa.Table):
        self.learn = table.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        words, rows, base = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
        for part in T.slices(table.select(["text"])):
            t = T.tokenize(part.column("text"), T.SPACED, True)
            at = np.cumsum(t.counts + 1) - 1  # where each row's end stands
            sequence = np.full(int(t.counts.sum()) + t.rows, _END, dtype=_U)
            inner = np.ones(len(sequence), dtype=bool)
            inner[at] = False
            sequence[inner] = t.hashes()
            words.append(sequence)
            rows.append(np.repeat(np.arange(t.rows, dtype=np.int64) + base, t.counts + 1))
            base += t.rows
        word, self.row, self.rows = np.concatenate(words), np.concatenate(rows), base
        self.first = np.ones(len(word), dtype=bool)
        self.first[1:] = self.row[1:] != self.row[:-1]
        self.on = self.learn[self.row]
        keys, at = np.unique(word, return_inverse=True)
        none = np.zeros(len(keys), np.int64)
        self.words = Grams(keys, np.bincount(at[self.on], minlength=len(keys)), at, none, none)
        self.end = int(np.searchsorted(keys, _END)) if len(keys) else -1

    def pairs(self) -> Grams:
        """Bigrams; the word before a text's first one is the beginning, which has the number of words as its own."""
        n, at = len(self.words.keys), self.words.at
        before = np.full(len(at), n)
        before[1:] = at[:-1]
        before[self.first] = n
        codes, pair = np.unique(before * (n + 1) + at, return_inverse=True)
        left, right, m = codes // (n + 1), codes % (n + 1), T.multipliers(2, 77)
        known = np.append(self.words.keys, _BEGIN)
        return Grams(T.mix(known[left] * m[0] + known[right] * m[1]), np.bincount(pair[self.on], minlength=len(codes)), pair, left, right)

    def triples(self, pairs: Grams) -> Grams:
        """Trigrams: of each token but a text's first, with the bigrams that end before it and in it."""
        at = np.flatnonzero(~self.first)
        codes, triple = np.unique(pairs.at[at - 1] * max(1, len(pairs.keys)) + pairs.at[at], return_inverse=True)
        left, right, m = codes // max(1, len(pairs.keys)), codes % max(1, len(pairs.keys)), T.multipliers(3, 78)
        known = np.append(self.words.keys, _BEGIN)
        keys = T.mix(known[pairs.left[left]] * m[0] + known[pairs.left[right]] * m[1] + known[pairs.right[right]] * m[2])
        whole = np.full(len(self.row), -1)
        whole[at] = triple
        return Grams(keys, np.bincount(triple[self.on[at]], minlength=len(codes)), whole, left, right)

    def code(self, grams: list[Grams], number: np.ndarray, bits: int) -> None:
        """Gives the last grams keys that are made of their words' numbers, where those fit."""
        last, order = grams[-1], len(grams)
        if order * bits > 64:
            return
        if order == 2:
            words = (last.left, last.right)
        else:
            words = (grams[1].left[last.left], grams[1].right[last.left], grams[1].right[last.right])
        code = np.zeros(len(last.keys), dtype=_U)
        for w in words:
            code = code << _U(bits) | number[w]
        last.keys = spread(code, order * bits)

    def known(self, answers: dict[int, np.ndarray], numbers: Numbers | None = None) -> tuple[list[Grams], list[np.ndarray], np.ndarray | None]:
        """(n-grams of each order, corpus counts of those orders that are answered, what of the next order to ask for)."""
        grams, counts = [self.words], []
        wanted = np.ones(len(self.words.keys), dtype=bool)
        for order in (1, 2, 3):
            if order > 1:
                grams.append(self.pairs() if order == 2 else self.triples(grams[1]))
                if order == 2:
                    elsewhere = np.append(elsewhere, True)  # the beginning
                    number = None if numbers is None else numbers.of(elsewhere)
                if number is not None:
                    self.code(grams, number, numbers.bits())
                wanted = elsewhere[grams[-1].left] & elsewhere[grams[-1].right]
            if order not in answers:
                return grams, counts, wanted
            _, _, place = grams[-1].ask(wanted)
            if len(place) and place.max() >= len(answers[order]):
                raise RuntimeError("a block's answers don't fit its texts")
            total, elsewhere = grams[-1].own.copy(), np.zeros(len(wanted), dtype=bool)
            elsewhere[wanted] = answers[order][place] & 1
            total[elsewhere] = answers[order][place][elsewhere[wanted]] >> 1
            counts.append(total)
        return grams, counts, None


#: below so many texts left, each is read by itself
FEW = 24


@dataclass
class Automaton:
    """States are numbers, 0 the root; an arc goes from a state (source) on a word to another (leads)."""

    source: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    leads: np.ndarray
    level: np.ndarray  # by state: how many words it stands for
    fails: np.ndarray  # by state: where its failure arc leads
    fail_weight: np.ndarray
    start: int
    arcs: np.ndarray  # levels x tokens: the arc on the token from the state of that level that its text is in; -1: none

    def read(self, state: int, word: int) -> tuple[float, int]:
        """(weight, next state) of one word read in a state, its arc searched for."""
        total = 0.0
        while not len(arc := np.flatnonzero((self.source == state) & (self.word == word))):
            total += float(self.fail_weight[state])
            state = int(self.fails[state])
        return total + float(self.weight[arc[0]]), int(self.leads[arc[0]])

    def traverse(self, row: np.ndarray, rows: int) -> np.ndarray:
        """The summed log10 weights of each row's words, read from left to right.

        All rows advance together by a word, each in its own state, until few are left.
        """
        length = np.bincount(row, minlength=rows)
        begin = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, total = np.full(rows, self.start), np.zeros(rows)
        together = int(length[FEW - 1]) if rows >= FEW else 0
        live = np.searchsorted(-length, -np.arange(1, together + 1), side="right")
        for j, n in enumerate(live.tolist()):
            s, at, add = state[:n].copy(), begin[:n] + j, total[:n]
            arc = self.arcs[self.level[s], at]
            lost = np.flatnonzero(arc < 0)
            while len(lost):
                add[lost] += self.fail_weight[s[lost]]
                s[lost] = self.fails[s[lost]]
                arc[lost] = self.arcs[self.level[s[lost]], at[lost]]
                lost = lost[arc[lost] < 0]
            add += self.weight[arc]
            state[:n] = self.leads[arc]
        for k in range(min(rows, FEW)):
            total[k] += self._rest(int(state[k]), int(begin[k]) + min(together, int(length[k])), int(begin[k] + length[k]))
        out = np.zeros(rows)
        out[order] = total
        return out

    def _rest(self, state: int, at: int, end: int) -> float:
        level, fails, fail_weight, weight, leads = self.level.item, self.fails.item, self.fail_weight.item, self.weight.item, self.leads.item
        total = 0.0
        for by_level in zip(*self.arcs[:, at:end].tolist(), strict=True):
            while (arc := by_level[level(state)]) < 0:
                total += fail_weight(state)
                state = fails(state)
            total += weight(arc)
            state = leads(arc)
        return total


def root_weights(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))


def compiled(block: Block, grams: list[Grams], counts: list[np.ndarray], n: int, v: int, priors: tuple[float, float]) -> Automaton:
    """The states and arcs that the block's texts can reach."""
    (_, pairs, triples), (c1, c2, c3), (m2, m3) = grams, counts, priors
    words = len(c1)
    # the beginning counts as often as the end; nothing follows the end
    context = np.append(c1, c1[block.end] if block.end >= 0 else 0)
    number = np.arange(words + 1)
    word_state = np.where((context > 0) & (number != block.end), 1 + number, 0)
    pair_state = np.where((c2 > 0) & (pairs.right != block.end), 2 + words + np.arange(len(c2)), 0)
    size = 2 + words + len(c2)
    fails, fail_weight = np.zeros(size, dtype=np.int64), np.zeros(size)
    fail_weight[1 : words + 2] = np.log10(m2 / (context + m2))
    fails[words + 2 :] = word_state[pairs.right]
    fail_weight[words + 2 :] = np.log10(m3 / (c2 + m3))
    p1 = (c1 + 0.5) / (n + 0.5 * (v + 1))
    p2 = (c2 + m2 * p1[pairs.right]) / (context[pairs.left] + m2)
    p3 = (c3 + m3 * p2[triples.right]) / (c2[triples.left] + m3)
    two, three = np.flatnonzero(c2 > 0), np.flatnonzero(c3 > 0)
    source = np.concatenate([np.zeros(words, np.int64), word_state[pairs.left[two]], pair_state[triples.left[three]]])
    word = np.concatenate([np.arange(words), pairs.right[two], pairs.right[triples.right[three]]])
    leads = np.concatenate([word_state[:words], pair_state[two], pair_state[triples.right[three]]])
    weight = np.log10(np.concatenate([p1, p2[two], p3[three]]))
    level = np.zeros(size, dtype=np.int8)
    level[1 : words + 2], level[words + 2 :] = 1, 2
    of_pair, of_triple = np.full(len(c2), -1, np.int32), np.full(len(c3) + 1, -1, np.int32)  # the last one is for no trigram
    of_pair[two], of_triple[three] = words + np.arange(len(two)), words + len(two) + np.arange(len(three))
    arcs = np.stack([block.words.at.astype(np.int32), of_pair[pairs.at], of_triple[triples.at]])
    return Automaton(source, word, weight, leads, level, fails, fail_weight, int(word_state[words]), arcs)


REQUEST = "dest long, block long, level int, bucket int, keys binary, counts binary"
ANSWER = "block long, level int, bucket int, counts binary"


def _rows(block: int, level: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    """Requests for sorted keys, one for each bucket (equal ranges of the key space) that has some."""
    of = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]).tolist() if len(of) else [0]
    return [(int(of[a]), block, level, int(of[a]), pack(keys[a:b]), pack_counts(counts[a:b])) for a, b in zip(at, at[1:], strict=False)]


_REQUEST = pa.schema([("dest", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([_REQUEST.field(n) for n in ("block", "level", "bucket", "counts")])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _answered(answers: pa.Table) -> dict[int, np.ndarray]:
    """Answers by order, in the order of the keys asked for: twice the count and one more if several blocks asked, else 0.

    As order 0, the places of the words that several blocks asked for (numbered).
    """
    answers = answers.sort_by([("level", "ascending"), ("bucket", "ascending")])
    found: dict[int, list[np.ndarray]] = {}
    for level, counts in zip(answers.column("level").to_pylist(), answers.column("counts").to_pylist(), strict=True):
        counts = unpack_counts(counts)
        found.setdefault(level, []).append(counts if level else np.cumsum(counts))
    return {k: np.concatenate(x) for k, x in found.items()}


def _numbers(got: dict[int, np.ndarray], answers: pa.Table, buckets: int) -> Numbers:
    return Numbers(got.pop(0, np.zeros(0, np.int64)), buckets, answers.column("stride")[0].as_py())


def _ask(buckets: int, all_buckets: int):
    """A block's next requests; what it knows already goes to itself (dest < 0), to come back beside the answers."""

    def first(texts: pa.Table) -> pa.Table:
        return after(texts, None)

    def after(texts: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("answers for a block without texts")
        texts = texts.combine_chunks()
        number, block = texts.column("block")[0].as_py(), Block(texts)
        got = _answered(answers) if answers is not None else {}
        numbers = None if answers is None else _numbers(got, answers, all_buckets)
        grams, _, wanted = block.known(got, numbers)
        keys, own, _ = grams[-1].ask(wanted)
        rows = [(-1 - number, number, level, 0, b"", pack_counts(c)) for level, c in got.items()]
        if numbers is not None:
            rows.append((-1 - number, number, 0, 0, b"", pack_places(numbers.places)))
        if not len(keys):
            rows.append((-1 - number, number, len(grams), 0, b"", pack_counts(own)))
        return _table(rows + _rows(number, len(grams), keys, own, buckets), _REQUEST)

    return first, after


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their answers, each row's places among them, where each row begins) of requests."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    own = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, weights=own >> 1, minlength=len(distinct)).astype(np.int64)
    asked = np.bincount(place, weights=1 + (own & 1), minlength=len(distinct))
    return distinct, count * 2 + (asked > 1), place, np.cumsum([0, *map(len, keys)])


def _echo(table: pa.Table) -> bool:
    return table.column("dest")[0].as_py() < 0


def _totals(table: pa.Table) -> pa.Table:
    """Training tokens, distinct training words and words with numbers of a bucket of words."""
    if _echo(table):
        return pa.table({c: pa.array([], pa.int64()) for c in ("n", "v", "stride")})
    _, sums, _, _ = _summed(table)
    return pa.table({c: pa.array([int(x.sum())], pa.int64()) for c, x in (("n", sums >> 1), ("v", sums > 1), ("stride", sums & 1))})


def numbered(bucket: int, sums: np.ndarray) -> np.ndarray:
    """By key of a bucket of words: its place, which is its rank among the keys that several blocks have, beside the bucket's number."""
    return (bucket << 32) + np.cumsum(sums & 1) - 1


def _given(kept: pa.Table, sums: np.ndarray, places: np.ndarray | None, place: np.ndarray, at: np.ndarray) -> pa.Table:
    """Answers to requests (kept) whose keys have those places among sums; with places also their words' places.

    Who alone asked for a key knows its count.
    """
    parts, told = [place[a:b] for a, b in zip(at, at[1:], strict=False)], np.where(sums & 1, sums, 0)
    counts = kept.append_column("counts", pa.array([pack_counts(told[k]) for k in parts], pa.binary()))
    if places is None:
        return counts
    zero = kept.set_column(1, "level", pa.array(np.zeros(len(parts)), pa.int32()))
    return pa.concat_tables([counts, zero.append_column("counts", pa.array([pack_places(places[k[sums[k] & 1 > 0]]) for k in parts], pa.binary()))])


def _answer(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    kept = table.select(["block", "level", "bucket"])
    if _echo(table):
        return kept.append_column("counts", table.column("counts"))
    _, sums, place, at = _summed(table)
    words = table.column("level")[0].as_py() == 1
    return _given(kept, sums, numbered(table.column("dest")[0].as_py(), sums) if words else None, place, at)


def _merge(buckets: int, parts: int):
    """The requests of a group of blocks as one, to the buckets themselves."""

    def run(table: pa.Table) -> pa.Table:
        if _echo(table):
            return _REQUEST.empty_table()
        keys, sums, _, _ = _summed(table)
        number = table.column("dest")[0].as_py() * parts + table.column("part")[0].as_py()
        return _table(_rows(number, table.column("level")[0].as_py(), keys, sums, buckets), _REQUEST)

    return run


def _hand_down(table: pa.Table, answers: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    kept = table.select(["block", "level", "bucket"])
    if _echo(table):
        return kept.append_column("counts", table.column("counts"))
    _, _, place, at = _summed(table)
    got, level = _answered(answers), table.column("level")[0].as_py()
    places = None
    if level == 1:
        places = np.zeros(len(got[1]), np.int64)
        places[got[1] & 1 > 0] = got[0]
    return _given(kept, got[level], places, place, at)


def _resolve(asked: DataFrame, buckets: int, fan: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(answers, the requests as the buckets got them)."""
    if buckets <= fan:
        return asked.groupBy("dest").applyInArrow(_answer, ANSWER), asked
    parts = max(2, -(-2 * size // (fan * MERGED_BYTES)))
    dealt = asked.withColumn("part", F.when(F.col("dest") < 0, 0).otherwise(F.pmod(F.xxhash64("block"), F.lit(parts))).cast("long"))
    merged = dealt.groupBy("dest", "part").applyInArrow(_merge(buckets, parts), REQUEST)
    up = merged.groupBy("dest").applyInArrow(_answer, ANSWER)
    up = up.select(F.floor(F.col("block") / parts).cast("long").alias("dest"), F.pmod("block", F.lit(parts)).cast("long").alias("part"), "level", "bucket", "counts")
    return dealt.groupBy("dest", "part").cogroup(up.groupBy("dest", "part")).applyInArrow(_hand_down, ANSWER), merged


def _score(priors: tuple[float, float], buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("answers for a block without texts")
        texts = texts.combine_chunks()
        block = Block(texts)
        got = _answered(answers.select(["level", "bucket", "counts"]))
        grams, counts, _ = block.known(got, _numbers(got, answers, buckets))
        n, v = answers.column("n")[0].as_py(), answers.column("v")[0].as_py()
        score = compiled(block, grams, counts, n, v, priors).traverse(block.row, block.rows)
        per_row = lambda x: np.bincount(block.row, weights=x, minlength=block.rows)
        known, base = per_row(counts[0][block.words.at] > 0).astype(np.int64), per_row(root_weights(counts[0], n, v)[block.words.at])
        tokens = np.bincount(block.row, minlength=block.rows)
        names = ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([texts.column("k"), pc.invert(texts.column("learn")), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(block.rows, n), pa.int64()), pa.array(base), pa.array(score)], names=names)

    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, priors: tuple[float, float] = PRIORS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the documents whose crc32 of the id as text leaves another remainder
    than 1 by folds, and scores all.  Texts are shuffled once, into blocks.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    # rows that are equal are spread too, by where they stand in their file
    block = F.pmod(F.xxhash64(key, text, F.shiftright(F.monotonically_increasing_id(), 6)), F.lit(blocks))
    dealt = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (~held_out(key, folds)).alias("learn"), block.alias("block"))
    first, after = _ask(min(buckets, fan), buckets)
    answers, totals = None, None
    for order in (1, 2, 3):
        if order == 1:
            asked = dealt.groupBy("block").applyInArrow(first, REQUEST)
        else:
            asked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(after, REQUEST)
        answers, final = _resolve(asked, buckets, fan, size)
        if order == 1:
            # N, V and the stride reach every block beside its answers, as a broadcast of one row
            sums = final.groupBy("dest").applyInArrow(_totals, "n long, v long, stride long")
            totals = sums.agg(*[F.coalesce(f(c), F.lit(0)).alias(c) for c, f in (("n", F.sum), ("v", F.sum), ("stride", F.max))])
        answers = answers.crossJoin(F.broadcast(totals))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(priors, buckets), schema).withColumnRenamed("k", key)
