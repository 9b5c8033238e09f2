"""Benchmark decontamination: BM25 over test items by block-max WAND, then overlap of question and answer.

The test items are the indexed collection and every passage of every training
document is a query.  A posting's impact is the term's BM25 weight in the item as
a share of the item's own best score, so an item asked for by itself scores 1.
All items at or above a threshold are retrieved: block-max WAND skips items whose
terms' (and blocks') greatest impacts can't reach it.  A retrieved item leaks if
the passage holds enough of the word trigrams of its question and of its answer.

Items are indexed by classes of their length (powers of two from LEAST_WORDS on).
Passages are two strides long and begin at every stride, the stride being the most
words that an item of the class may have, so an item that stands in a text stands
whole in one of its passages, and no item's passages hang on other items.  Before the traversal a passage is ruled out when even
bounds of its distinct terms don't add up to the threshold (Index.screen), which
loses nothing.

Items come in blocks of a bounded size of text (one block, unless the test set is
very large); only a block's index is broadcast, with document frequencies of the
whole set, and every block runs over all documents.  No document is shuffled.

Question and answer: columns, if they are named; else a text is split after
its last "?" if words follow, or before its last quarter of words.

Edge cases: null texts are empty, items without words never match, items shorter
than three words are compared by whole word runs; repeated items of one id each
match and report the best; items with a null id are left out; an empty test set
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm import textops as T

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.7, 0.7
BLOCK_BYTES, POSTING_BLOCK, LEAST_WORDS = 8_000_000, 32, 16
_END = 1 << 60


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    t = T.tokenize(pa.array(texts, pa.string()), T.ALNUM, True)
    h = t.hashes()
    return [h[a:b] for a, b in zip(t.first[:-1], t.first[1:], strict=True)]


def split_item(text: str) -> tuple[str, str]:
    head, mark, tail = text.rpartition("?")
    if mark and len(item_words([tail])[0]) and len(item_words([head])[0]):
        return head, tail
    words = text.split()
    n = max(1, len(words) // 4)
    return " ".join(words[:-n]), " ".join(words[-n:])


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words."""
    if n == 0 or len(h) < n:
        return np.zeros(0, np.uint64)
    m = T.multipliers(n, 31)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * m[k]
    return np.unique(T.mix(out))


def _part(h: np.ndarray) -> tuple[np.ndarray, int]:
    n = min(3, len(h))
    return runs(h, n), n


class Index:
    """Postings of one block's items of one class of length, ordered by item, in blocks with their greatest impact."""

    def __init__(self, ids: list, questions: list[str], answers: list[str], df: dict[int, int], n: int, mean: float, stride: int = LEAST_WORDS):
        self.stride = stride
        words = [np.concatenate(x) for x in zip(item_words(questions), item_words(answers), strict=True)]
        self.ids = ids
        self.parts = [[_part(h) for h in pair] for pair in zip(item_words(questions), item_words(answers), strict=True)]
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, h in enumerate(words):
            terms, tf = np.unique(h, return_counts=True)
            idf = np.array([np.log(1 + (n - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            for t, w in zip(terms.tolist(), (weight / weight.sum()).tolist() if len(terms) else [], strict=True):
                postings.setdefault(t, []).append((i, w))
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        lists = [postings[t] for t in self.terms.tolist()]
        self.items = [[i for i, _ in x] for x in lists]
        self.impacts = [[w for _, w in x] for x in lists]
        self.block_max = [[max(x[k : k + POSTING_BLOCK]) for k in range(0, len(x), POSTING_BLOCK)] for x in self.impacts]
        self.greatest = np.array([max(x) for x in self.block_max])
        self.screens: dict[float, tuple] = {}
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def screen(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a passage's rare terms must give each item for it to reach the threshold.

        Frequent terms together give item i no more than c(i), so its rare terms must
        give threshold - c(i).  A term counts as frequent, the most frequent first,
        while no item's c(i) grows past two thirds of the threshold.  Returns the needs
        by item, and the rare terms' postings: offsets by term, items, impacts.
        """
        if threshold not in self.screens:
            given = np.zeros(len(self.ids))
            size = np.zeros(len(self.terms), dtype=np.int64)
            for t in sorted(range(len(self.terms)), key=lambda t: (-len(self.items[t]), t)):
                i, w = np.array(self.items[t]), np.array(self.impacts[t])
                if (given[i] + w <= threshold * 2 / 3).all():
                    given[i] += w
                else:
                    size[t] = len(i)
            rare = np.flatnonzero(size).tolist()
            items = np.array([i for t in rare for i in self.items[t]], dtype=np.int64)
            impacts = np.array([w for t in rare for w in self.impacts[t]])
            self.screens[threshold] = threshold - given, np.concatenate([[0], np.cumsum(size)]), items, impacts
        return self.screens[threshold]

    def candidates(self, half: np.ndarray, term: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
        """Passages (by their first half) in which some item can reach the threshold."""
        need, offsets, items, impacts = self.screen(threshold)
        n = offsets[term + 1] - offsets[term]
        on = n > 0
        half, term, n = half[on], term[on], n[on]
        at = np.repeat(offsets[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        half, item, impact = np.repeat(half, n), items[at], impacts[at]
        back = half > 0
        back[back] &= ~last[half[back] - 1]  # a passage is a half and the next one of the same row
        keys = np.concatenate([half, half[back] - 1]) * len(need) + np.concatenate([item, item[back]])
        keys, inverse = np.unique(keys, return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([impact, impact[back]]), minlength=len(keys))
        return np.unique(keys[sums >= need[keys % len(need)] - 1e-9] // len(need))

    def term_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the words that the index has."""
        on = np.flatnonzero(self.flags[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[on]), max(0, len(self.terms) - 1))
        hit = self.terms[at] == h[on]
        return on[hit], at[hit]

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) at or above the threshold for a query of distinct terms: block-max WAND."""
        least = threshold - 1e-9
        cursors = [[self.items[t][0], 0, t] for t in terms]  # current item, position, term
        greatest, found = self.greatest, []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == _END:
                    break
                bound += greatest[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, edge = 0.0, _END
            for c in cursors[: pivot + 1]:
                blocks, items, b = self.block_max[c[2]], self.items[c[2]], c[1] // POSTING_BLOCK
                while b < len(blocks) and items[min(len(items), (b + 1) * POSTING_BLOCK) - 1] < item:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b]
                    edge = min(edge, items[min(len(items), (b + 1) * POSTING_BLOCK) - 1] + 1)
            if bound < least:
                # no item before the first of these blocks ends, or the next cursor, can reach it
                target = min(edge, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else _END)
                target = max(target, item + 1)
                for c in cursors[: pivot + 1]:
                    self._seek(c, target)
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    self._seek(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        self._seek(c, item)

    def _seek(self, c: list[int], item: int) -> None:
        items, p = self.items[c[2]], c[1]
        n = len(items)
        while p < n and items[p] < item:
            q = (p // POSTING_BLOCK + 1) * POSTING_BLOCK  # a whole block at a time where it ends before the item
            p = q if q <= n and items[q - 1] < item else p + 1
        c[1], c[0] = p, items[p] if p < n else _END

    def leaks(self, texts: tuple[T.Tokens, np.ndarray], threshold: float, overlap: float) -> list[tuple[int, int, int, float, float, float]]:
        """(row, item, first word, score, question and answer overlap): of each leaking pair the passage that holds most of it.

        texts: as read gives them.
        """
        if not len(self.terms):
            return []
        (t, h), stride = texts, self.stride
        at, term = self.term_ids(h)
        # halves: a row's words in strides; a passage is a half and the next
        halves = -(-t.counts // stride)
        base = np.concatenate([[0], np.cumsum(halves)])
        half = base[t.row[at]] + (at - t.first[t.row[at]]) // stride
        keys = np.unique(half * len(self.terms) + term)
        half, term = keys // len(self.terms), keys % len(self.terms)
        start = np.searchsorted(half, np.arange(int(base[-1]) + 1))
        owner = np.repeat(np.arange(t.rows), halves)
        last = np.zeros(int(base[-1]), dtype=bool)
        last[base[1:][halves > 0] - 1] = True
        best: dict[tuple[int, int], tuple] = {}
        for p in self.candidates(half, term, last, threshold).tolist():
            stop = start[p + 1] if last[p] else start[min(p + 2, len(start) - 1)]
            terms = np.unique(term[start[p] : stop])
            got = self.retrieve(terms.tolist(), threshold)
            if not got:
                continue
            r = int(owner[p])
            first = int(p - base[r]) * stride
            words = h[t.first[r] + first : min(t.first[r + 1], t.first[r] + first + 2 * stride)]
            has: dict[int, np.ndarray] = {}
            for item, score in got:
                (q, qn), (a, an) = self.parts[item]
                for n in {qn, an} - {0}:
                    if n not in has:
                        has[n] = runs(words, n)
                q, a = (float(np.isin(g, has[n]).mean()) if n else 1.0 for g, n in ((q, qn), (a, an)))
                if q >= overlap and a >= overlap:
                    rank = (min(q, a), score, -first)
                    if (r, item) not in best or rank > best[r, item][0]:
                        best[r, item] = rank, (r, item, first, score, q, a)
        return sorted(x for _, x in best.values())


def read(column: pa.Array) -> tuple[T.Tokens, np.ndarray]:
    t = T.tokenize(column, T.ALNUM, True)
    return t, t.hashes()


def build_indexes(items: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, question: str | None = None, answer: str | None = None) -> list[list[Index]]:
    """For each block of items an index for each class of length.  Each block's text is bounded by about block_bytes."""
    both = question is not None and answer is not None
    wide = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((question, "q"), (answer, "a"))] if both else [F.coalesce(F.col(text).cast("string"), F.lit("")).alias("q"), F.lit("").alias("a")]))
    whole = F.concat_ws(" ", "q", "a")

    def terms(batches):
        for batch in batches:
            for part in T.slices(batch, "t"):
                for i, h in enumerate(item_words(part.column("t").to_pylist())):
                    u = np.unique(h)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), len(h)), pa.int64()), pa.array(np.arange(len(u)) == 0)], ["term", "words", "first"])

    counted = wide.select(whole.alias("t")).mapInArrow(terms, "term long, words long, first boolean")
    n, words = counted.where("first").agg(F.count("*"), F.sum("words")).first()
    if not n:
        return []
    blocks = max(1, -(-int(wide.agg(F.sum(F.octet_length(whole))).first()[0] or 0) // block_bytes))
    df = counted.groupBy("term").count()
    out = []
    for b in range(blocks):
        rows = wide.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r.id, r.q, r.a))
        pairs = [(r.q, r.a) if both else split_item(r.q) for r in rows]
        held = item_words([f"{q} {a}" for q, a in pairs])
        block_terms = {int(x) for h in held for x in h.view(np.int64)}
        wanted = items.sparkSession.createDataFrame([(t,) for t in block_terms], "term long") if block_terms else None
        freq = {r["term"] & 0xFFFFFFFFFFFFFFFF: r["count"] for r in df.join(wanted, "term", "left_semi").collect()} if wanted else {}
        classes: dict[int, list[int]] = {}
        for i, h in enumerate(held):
            classes.setdefault(max(LEAST_WORDS, 1 << len(h).bit_length()), []).append(i)
        out.append([Index([rows[i].id for i in which], [pairs[i][0] for i in which], [pairs[i][1] for i in which], freq, n, words / n, stride) for stride, which in sorted(classes.items())])
    return out


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, question: str | None = None, answer: str | None = None) -> DataFrame:
    """(key, item key, first_word, score, question_overlap, answer_overlap): one row for each document and leaking item.

    question, answer: columns of items that hold them, if any (then item_text isn't read).
    """
    spark, kind = docs.sparkSession, items.schema[item_key].dataType
    schema = f"k {docs.schema[key].dataType.simpleString()}, n long, first_word long, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))

    def over(block) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part in T.slices(batch):
                    texts, first = read(part.column("text")), 0
                    for index in block.value:
                        found = index.leaks(texts, threshold, overlap)
                        cols = list(zip(*found, strict=True)) if found else [[]] * 6
                        numbers = pa.array([first + i for i in cols[1]], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(cols[0], pa.int64())), numbers, pa.array(cols[2], pa.int64()), *(pa.array(np.round(np.array(c, dtype=float), 9)) for c in cols[3:])], ["k", "n", "first_word", "score", "question_overlap", "answer_overlap"])
                        first += len(index.ids)

        return source.mapInArrow(run, schema)

    out = over(spark.sparkContext.broadcast([])).withColumn("i", F.lit(None).cast(kind)).where(F.lit(False))
    for block in build_indexes(items, item_key, item_text, question=question, answer=answer):
        # the block's ids by number, so that a key may be of any type: as bounded as the block
        ids = spark.createDataFrame(list(enumerate(x for index in block for x in index.ids)), StructType([StructField("n", LongType()), StructField("i", kind)]))
        out = out.unionByName(over(spark.sparkContext.broadcast(block)).join(F.broadcast(ids), "n"))
    return out.groupBy("k", "i").agg(*[F.max_by(c, F.struct(F.least("question_overlap", "answer_overlap"), "score", -F.col("first_word"))).alias(c) for c in ("first_word", "score", "question_overlap", "answer_overlap")]).withColumnsRenamed({"k": key, "i": item_key})


def drop_leaking(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, question: str | None = None, answer: str | None = None) -> DataFrame:
    """The documents in which no item leaks, with their own columns; no shuffle."""
    names, at = docs.columns, docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def without(block):
        def run(batches):
            for batch in batches:
                batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
                for part in T.slices(batch, f"c{at}"):
                    clean, texts = np.ones(part.num_rows, dtype=bool), read(part.column(at))
                    for index in block.value:
                        clean[[x[0] for x in index.leaks(texts, threshold, overlap)]] = False
                    yield part.filter(pa.array(clean))

        return run

    for block in build_indexes(items, item_key, item_text, question=question, answer=answer):
        plain = plain.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(block)), plain.schema)
    return plain.toDF(*names)
