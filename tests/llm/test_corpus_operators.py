"""Operators that look at many rows together, against plain versions of themselves."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm_scoring as M
from lodestone.llm import mixing as X
from lodestone.llm import near_join as N
from lodestone.llm import quality as Q
from lodestone.llm import textops as T
from lodestone.llm import toxicity as O
from lodestone.llm import url_filters as U
from lodestone.llm.components import connected_components
from lodestone.scratch import Cuts
from tests.llm.helpers import ALNUM, EDGE_TEXTS, SPACED, UPPER, edge_docs, words

DOCS = "doc_id long, text string, source string"

# components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(40)] + [(None, 1), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), Cuts(spark)).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Cuts(spark)).count() == 0


def test_components_settled_from_the_start_take_one_round(spark):
    """Every table is a job of as many tasks as there are partitions, of which the driver keeps records."""
    cuts = Cuts(spark)
    stars = [(10 * i + j, 10 * i) for i in range(9) for j in range(1, 8)]
    got = connected_components(spark.createDataFrame(stars, "a long, b long"), cuts).collect()
    assert {(r.node, r.component) for r in got} == {(x, x // 10 * 10) for pair in stars for x in pair}
    assert len(cuts.made) <= 5


# mixing


def plain_targets(sizes, most=3.0, weights=(1.0, 2.0, 3.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_targets_and_taken(spark):
    rnd = random.Random(8)
    rows = [(i, words(rnd, rnd.choice([0, 3, 20, 200])), rnd.choices(["a", "é", "B", "z", "tiny", None], [40, 20, 20, 15, 1, 4])[0]) for i in range(600)] + [(900, "one two", "tiny"), (901, None, "empty")]
    df = spark.createDataFrame(rows, DOCS)
    out = X.mix_sources(df, group_rows=50).collect()
    assert len(out) == len(rows)
    source, size = {i: s for i, _, s in rows}, {i: len(SPACED.findall(t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i in source:
        sizes[source[i]] += size[i]
    targets, taken = plain_targets(sizes), Counter()
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(targets[s])
        assert r.taken == r.repeats * r.size <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    again = X.mix_sources(df.orderBy("text"), group_rows=50).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_other_budgets(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b", "y")], DOCS)
    assert {r.target for r in X.mix_sources(df, budget=1e9).collect()} == {12.0, 6.0}
    assert {r.taken for r in X.mix_sources(df, budget=0).collect()} == {0}


def test_mixing_edges(spark):
    assert X.mix_sources(edge_docs(spark)).count() == len(EDGE_TEXTS) + 2
    assert X.mix_sources(edge_docs(spark).limit(0)).count() == 0
    docs = edge_docs(spark)
    taken = X.take_mix(docs)
    assert taken.columns == [*docs.columns, "mix_size", "source_size", "mix_target", "repeats", "taken"]
    assert X.take_mix(docs.limit(0)).count() == 0


def test_the_mix_keeps_texts_and_repeated_rows(spark):
    rnd = random.Random(8)
    rows = [(i, words(rnd, rnd.choice([1, 9, 80])), rnd.choice(["a", "b", "c", None])) for i in range(120)] + [(7, "the same row", "a")] * 700 + [(None, "no id", "b"), (2**60 + 1, "large id", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    mixed, taken = X.mix_sources(docs, group_rows=50).collect(), X.take_mix(docs, group_rows=50).collect()
    assert len(mixed) == len(rows) and {r.doc_id for r in mixed} == {r[0] for r in rows}
    total, kept = Counter(), Counter()
    for r in mixed:
        total[r.doc_id, r["size"]] += r.repeats
    for r in taken:
        kept[r.doc_id, r["size"]] += r.repeats
        assert (r.doc_id, r.text, r.source) in rows and r.taken == r.repeats * r["size"] > 0
    assert +total == +kept and len({(r.doc_id, r.text) for r in taken}) == len(taken)
    copies = [r.repeats for r in mixed if r.doc_id == 7 and r["size"] == 3]
    assert len(copies) == 700 and max(copies) - min(copies) <= 1


def test_every_document_may_be_taken(spark):
    """The longest document too, where the others can make up for it, under some seed; and targets are met under each."""
    rows = [(0, "w " * 60, "a")] + [(i, "w " * (i % 7 + 1), "a") for i in range(1, 200)] + [(200 + i, "w w", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    longest = []
    for seed in range(8):
        out = X.mix_sources(docs, seed=seed).collect()
        longest.append(next(r.repeats for r in out if r.doc_id == 0))
        for source in ("a", "b"):
            mine = [r for r in out if (r.doc_id < 200) == (source == "a")]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2
    assert len(set(longest)) == 2


# near join


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(UPPER))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset([("", t or "")])
    return out


def plain_join(rows, threshold=0.8):
    sets, members = plain_sets(rows), defaultdict(list)
    for i in sorted(sets):
        members[sets[i]].append(i)
    reps = {s: m[0] for s, m in members.items()}
    parent, links, classes = {i: i for i in reps.values()}, Counter(), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = list(reps.items())
    for n, (s, i) in enumerate(every):
        for t, j in every[:n]:
            if ("",) != next(iter(s))[:1] and ("",) != next(iter(t))[:1] and len(s & t) / len(s | t) >= threshold:
                links[i] += len(members[t])
                links[j] += len(members[s])
                classes[i] += 1
                classes[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = {}
    for s, i in every:
        for k in members[s]:
            out[k] = (i, root(i), len(members[s]), links[i] + len(members[s]) - 1, classes[i])
    return out


def near_rows(seed=3, groups=12, size=6, hot=40):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = words(rnd, rnd.choice([4, 12, 60, 200]), 2000).split()
        for k in range(hot if g == 0 else size):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(50)}"
            rows.append((len(rows), " ".join(w) if k % 2 else " ".join(w).upper() + "!"))
    return rows


@pytest.mark.parametrize("how", [{}, {"tile_rows": 5}, {"tile_rows": 5, "crowded": 4, "large": 1}], ids=["whole", "tiles", "nodes"])
def test_join_agrees_with_all_pairs(spark, how):
    rows = near_rows()
    got = {r.doc_id: tuple(r)[1:] for r in N.near_join(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert got == plain_join(rows)


def test_prefixes_differ_between_documents(spark):
    """Where many share a prefix it stays long, as far as the target allows; elsewhere it is the shortest."""
    rows = near_rows()
    cuts = Cuts(spark)
    sigs = N.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, N.TREES, N.DEPTH)
    classes = cuts.cut(sigs.groupBy("fp").agg(F.max("n").alias("n"), F.first("sig").alias("sig")))
    shared, _ = N.ask_forest(classes, cuts, N.TREES, N.DEPTH, 0.8, N.RECALL, 4)
    low, found = N.prefix_length(), defaultdict(dict)
    for r in shared.collect():
        found[bytes(r.fp)][r.t] = r.d
        assert low <= r.d <= N.DEPTH and (r.d == low or r.m > 4)
    assert {d for x in found.values() for d in x.values()} > {low}
    for lengths in found.values():
        miss = math.prod(1 - 0.8 ** lengths.get(t, low) for t in range(N.TREES))
        assert miss <= 1 - N.RECALL + 1e-12


@pytest.mark.parametrize("trees, depth, recall", [(16, 8, 0.999), (8, 6, 0.9), (24, 10, 0.99)])
def test_recall_of_the_forest(spark, trees, depth, recall):
    rnd = random.Random(trees)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(4):
            w = list(base)
            w[rnd.randrange(10, 100)] = f"e{rnd.randrange(10**9)}"
            w[rnd.randrange(10, 100)] = f"e{rnd.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    got = N.near_join(spark.createDataFrame(rows, "doc_id long, text string"), trees=trees, depth=depth, recall=recall, crowded=2)
    want = plain_join(rows)
    assert got.agg(F.sum("n_class_links")).first()[0] >= recall * sum(x[4] for x in want.values()) - 6


def test_texts_of_one_id_are_judged_each(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (5, a), (7, a), (3, b + " end"), (9, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in N.keep_one_of_each(docs).collect()) == [(3, b + " end"), (5, a), (9, "other words")]
    alone = spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")
    assert N.keep_one_of_each(alone).count() == 2


def test_long_common_texts(spark):
    """A third of the rows are one text, and a long text with wide characters has a near copy."""
    long = " ".join(f"é{i % 5000}x{i}" for i in range(60_000))
    rows = [(i, "the same text in all of these rows") for i in range(1500)] + [(2000, long), (2001, long + " more"), (2002, "x")]
    out = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in N.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 1503 and out[1499] == (0, 1500, 1499) and out[2001] == (2000, 1, 1) and out[2002] == (2002, 1, 0)


def test_prefix_length_reaches_the_target():
    d = N.prefix_length()
    assert 1 - (1 - 0.8**d) ** N.TREES >= N.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** N.TREES
    with pytest.raises(ValueError):
        N.prefix_length(trees=1, recall=0.9999)


def test_near_edges(spark):
    docs = edge_docs(spark)
    out = {(r.doc_id, r.class_id, r.n_copies) for r in N.near_join(docs).collect()}
    assert out == {(0, 0, 3), (1, 0, 3), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 2), (6, 5, 2), (None, None, 0)}
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 0), (True, 2), (True, 3), (True, 4), (True, 5)]
    assert N.near_join(docs.limit(0)).count() == 0 == N.keep_one_of_each(docs.limit(0)).count()


# language model


@pytest.mark.parametrize("how", [{}, {"fan": 2}], ids=["one level", "two levels"])
def test_scores_agree_with_plain_counts(spark, how):
    rnd = random.Random(9)
    rows = [(i, words(rnd, rnd.choice([0, 1, 5, 60]), 50), "s") for i in range(150)]
    rows += [(i + 150, t, "s") for i, t, _ in rows[:20]] + [(400 + i, f"only{i} here{i} only{i} here{i} the the", "s") for i in range(30)]
    token = {i: [*SPACED.findall(t.translate(UPPER)), None] for i, t, _ in rows}
    one, two, three = Counter(), Counter(), Counter()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in token}
    for i, w in token.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["^", *w], w, strict=False))
            three.update(zip(["^", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    context = one | {"^": one[None]}
    p1 = lambda x: (one[x] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, x: (two[a, x] + 7 * p1(x)) / (context.get(a, 0) + 7)
    p3 = lambda a, b, x: (three[a, b, x] + 3 * p2(b, x)) / (two[a, b] + 3)
    out = M.score_texts(spark.createDataFrame(rows, DOCS), priors=(7.0, 3.0), block_bytes=900, bucket_bytes=2000, **how).collect()
    assert len(out) == len(rows)
    for r in out:
        w = token[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(one[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w))
        assert r.score == pytest.approx(math.log10(p2("^", w[0])) + sum(math.log10(p3(a, b, x)) for a, b, x in zip(["^", *w], w, w[1:], strict=False)))


def test_every_state_adds_up_to_one():
    """Over the known words, the end and one unknown word, from every state, following failure arcs."""
    import numpy as np
    import pyarrow as pa

    block = M.Block(pa.table({"text": ["a b a", "b b", "a z a b a", "q a b z", "q z"], "learn": [True, True, True, False, False]}))
    grams = [block.words, block.pairs()]
    grams.append(block.triples(grams[1]))
    counts = [g.own for g in grams]
    n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
    a = M.compiled(block, grams, counts, n, v, (3.0, 2.0))
    states = {0, a.start, *a.leads.tolist()}
    assert len(states) > 8
    for state in states:
        assert sum(10 ** a.read(state, w)[0] for w in range(len(block.words.keys))) == pytest.approx(1)  # q is the unknown word
    assert (a.level[a.fails[a.leads]] < a.level[a.leads])[a.leads > 0].all()
    # the traversal carries the state that reading word by word leads to
    want = []
    for r in range(block.rows):
        state, total = a.start, 0.0
        for w in block.words.at[block.row == r].tolist():
            weight, state = a.read(state, w)
            total += weight
        want.append(total)
    assert a.traverse(block.row, block.rows) == pytest.approx(want)
    many = M.Block(pa.table({"text": ["a b a z"] * 9 + ["b b", ""] * 20 + ["a z a b a q"] * 9, "learn": [True] * 58}))
    grams = [many.words, many.pairs()]
    grams.append(many.triples(grams[1]))
    b = M.compiled(many, grams, [g.own for g in grams], 99, 5, (3.0, 2.0))
    together = b.traverse(many.row, many.rows)
    alone = [b._rest(b.start, int(np.flatnonzero(many.row == r)[0]), int(np.flatnonzero(many.row == r)[-1]) + 1) for r in range(many.rows)]
    assert together == pytest.approx(alone)


def test_ngrams_known_here_alone_are_not_asked_for():
    import numpy as np
    import pyarrow as pa

    block = M.Block(pa.table({"text": ["here alone", "the word"], "learn": [True, True]}))
    the, word = (int(np.flatnonzero(block.words.keys == T.tokenize(pa.array([x])).hashes()[0])[0]) for x in ("the", "word"))
    answer = block.words.own * 2
    answer[[the, word, block.end]] += 1
    grams, _, wanted = block.known({1: answer})
    asked = {(int(grams[1].left[i]), int(grams[1].right[i])) for i in np.flatnonzero(wanted)}
    begin = len(block.words.keys)
    assert asked == {(begin, the), (the, word), (word, block.end)}


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,2)", "string", "date", "int"])
def test_keys_of_any_type(spark, kind):
    make = "date_add(date'2024-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})"
    docs = spark.range(30).selectExpr(f"{make} as doc_id", "concat('the text ', id % 4, ' of some words and more, of the same kind') as text", "'s' as source")
    labels = docs.selectExpr("doc_id", "cast(substr(text, 10, 1) as int) % 2 as toxic", "cast(substr(text, 10, 1) as int) % 2 as quality")
    want = {r[0] for r in docs.select("doc_id").collect()}
    for out in (M.score_texts(docs), O.toxicity(docs, labels), Q.quality_rules(docs, labels), N.near_join(docs), X.mix_sources(docs)):
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        assert {r.doc_id for r in out.collect()} == want


def test_a_very_long_text(spark):
    """A text of a million characters and a word of a million, beside short ones."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 3000}" for i in range(160_000)), "s"), (2, "x" * 1_000_000, "s"), (3, "w1 w2 w3", "s")], DOCS)
    out = {r.doc_id: r for r in M.score_texts(docs).collect()}
    assert [out[i].n_tokens for i in (1, 2, 3)] == [160_001, 2, 4] and all(r.score < 0 for r in out.values())


def test_lm_edges(spark):
    out = M.score_texts(edge_docs(spark)).collect()
    assert len(out) == len(EDGE_TEXTS) + 2 and all(r.score < 0 for r in out)
    assert M.score_texts(edge_docs(spark).limit(0)).count() == 0
    only_held = spark.createDataFrame([(i, "a b", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], DOCS)
    assert {(r.train_tokens, r.base_score, r.n_known) for r in M.score_texts(only_held).collect()} == {(0, 0.0, 0)}


def test_keys_are_whole():
    """No bit of a bigram's or trigram's key is cut, whatever the size of the texts."""
    import pyarrow as pa

    block = M.Block(pa.table({"text": [" ".join(f"w{i * i % 997}" for i in range(3000))], "learn": [True]}))
    for grams in (pairs := block.pairs(), block.triples(pairs)):
        keys = grams.keys.tolist()
        assert len(set(keys)) == len(keys) and all(any(k >> b & 1 for k in keys) for b in range(64))


def test_bigrams_of_shared_words_have_short_keys():
    """Pairs and triples of word numbers, each its own key, in far less than the 64-bit hashes take."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(4)
    block = M.Block(pa.table({"text": [" ".join(f"w{int(rnd.random() ** 2 * 900)}" for _ in range(9000))], "learn": [True]}))
    shared = np.arange(len(block.words.keys)) % 3 > 0
    answer = {1: block.words.own * 2 + shared}
    numbers = M.Numbers(np.flatnonzero(shared) // 7 + (np.flatnonzero(shared) % 7 << 32), 7, 1 + int(np.flatnonzero(shared).max()) // 7)
    asked = [block.known(answer, x)[::2] for x in (None, numbers)]
    plain, coded = [g[1].ask(wanted)[0] for g, wanted in asked]
    assert (asked[0][1] == asked[1][1]).all() and len(plain) == len(coded) > 2000
    size = lambda keys: len(zlib.compress(M.pack(keys)))
    assert size(coded) < 0.5 * size(plain)
    for bits in (2, 5, 40, 63, 64):
        keys = M.spread(np.arange(4 if bits == 2 else 32, dtype=np.uint64), bits)
        assert len(set(keys.tolist())) == len(keys) and not (keys & np.uint64((1 << 64 - bits) - 1)).any()


def test_packing():
    import numpy as np

    keys = np.sort(np.array([0, 5, 2**63, 2**64 - 1], dtype=np.uint64))
    assert M.unpack(M.pack(keys)).tolist() == keys.tolist() and M.unpack(M.pack(keys[:0])).tolist() == []
    assert M.unpack_counts(M.pack_counts(np.array([1, 300, 2**40]))).tolist() == [1, 300, 2**40]


def test_answers_hold_only_what_a_block_cannot_know():
    import numpy as np

    keys = [np.array(k, dtype=np.uint64) for k in ([3, 5, 9], [5, 8, 9])]
    asked = M._table([(0, b, 2, 0, M.pack(k), M.pack_counts(np.array(c) * 2)) for b, (k, c) in enumerate(zip(keys, ([4, 1, 0], [2, 7, 0]), strict=True))], M._REQUEST)
    got = [M.unpack_counts(x).tolist() for x in M._answer(asked).column("counts").to_pylist()]
    assert got == [[0, 3 * 2 + 1, 1], [3 * 2 + 1, 0, 1]]


@pytest.mark.parametrize("n,bits,zeros", [(1, 64, 0), (2, 64, 0), (50, 7, 57), (300, 64, 0), (1000, 25, 30), (1000, 42, 13), (1000, 40, 0), (700, 10, 0)])
def test_packed_keys_take_what_their_differences_need(n, bits, zeros):
    """At most three bits more a key than its place among n evenly spread ones, and 15 bytes."""
    import numpy as np

    rnd = random.Random(n + bits)
    for base in (0, (1 << 64) - (1 << min(63, bits + zeros))):
        keys = np.array(sorted(base | x << zeros for x in {rnd.getrandbits(min(bits, 63 - zeros)) for _ in range(n)}), dtype=np.uint64)
        raw = M.pack(keys)
        assert M.unpack(raw).tolist() == keys.tolist()
        assert 8 * (len(raw) - 15) <= len(keys) * (max(0, bits - math.log2(len(keys))) + 3) + 8


# URLs

PAGES = [
    (1, "http://a.example.net/en/1", None), (2, "http://A.NET/x?q", None), (3, "https://example.com/de/2#f", None), (4, "https://example.com/en/2", None), (5, "http://www.site.org/fr/x", None),
    (6, None, None), (7, "no scheme", None), (8, "http://other.info/p", '<link href="https://example.com/de/2#f" rel="canonical">'), (9, "http://else.info/p", "<META HTTP-EQUIV='refresh' content='0; url=http://A.NET/x?q'>"),
    (10, "http://both.info/p", '<link rel=canonical href="http://else.info/p">'), (11, "http://both.info/q", '<link rel="canonical" href="http://www.site.org/fr/x">'), (12, "http://m.both.info/q.html", None), (13, "http://net", None), (14, "http://both.info/p", None), (15, "://", None), (16, "http://x.net/y", '<link rel="canonical" href="http://www.site.org/fr/x">'),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, forms=True).collect()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("a.net", "/x", "net/", "block"), 3: ("example.com", "/de/2", "example.com/de/", "block"), 4: ("example.com", "/en/2", None, "allow"),
        5: ("www.site.org", "/fr/x", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("other.info", "/p", None, "block"), 9: ("else.info", "/p", None, "block"), 10: ("both.info", "/p", None, "block"),
        11: ("both.info", "/q", None, "allow"), 12: ("m.both.info", "/q.html", None, "allow"), 13: ("net", "", None, "allow"), 14: ("both.info", "/p", None, "block"), 15: ("", "", None, "allow"), 16: ("x.net", "/y", "net/", "block"),
    }
    assert U.filter_urls(df.limit(0)).count() == 0
    # by its links alone no page is blocked for a variant of its address
    plain = {r.page_id: r.verdict for r in U.filter_urls(df).collect()}
    assert plain == {k: v[3] for k, v in got.items()}


def test_forms_are_no_links(spark):
    pages = spark.createDataFrame([(1, "http://www.a.info/p", None), (2, "https://a.info/p.html", '<link rel=canonical href="http://b.net/">')], "page_id long, url string, html string")
    verdicts = lambda **how: [r.verdict for r in U.filter_urls(pages, **how).orderBy("page_id").collect()]
    assert verdicts() == ["allow", "block"] and verdicts(forms=True) == ["block", "block"]


LINKS = [
    ("//example.com/de/2", "http://example.com/de/2"), ("../de/2", "http://example.com/de/2"), ("2", "http://example.com/en/2"), ("./2?x#y", "http://example.com/en/2?x#y"), ("/a/./b/../c", "http://example.com/a/c"), ("../../../x", "http://example.com/x"),
    ("?q=1", "http://example.com/en/1?q=1"), ("#top", None), ("", None), ("mailto:a@example.com", None), ("HTTPS://Other.org/x/..", "HTTPS://Other.org/"), ("  /s  ", "http://example.com/s"), ("/a&#47;b?c=1&amp;d=2", "http://example.com/a/b?c=1&d=2"), ("x/..", "http://example.com/en/"), ("http://h.org", "http://h.org"),
]


def test_links_are_resolved(spark):
    df = spark.createDataFrame([(t,) for t, _ in LINKS], "t string").select("t", U.resolved(F.lit("http://example.com/en/1?old#here"), F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == dict(LINKS)


def link_pages(seed, n=160):
    rnd = random.Random(seed)
    hosts = ["a.net", "example.net", "example.com", "m.site.org", "www.site.org", "else.info", "b.info", "c.info"]
    url = lambda: f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randrange(40)}"
    pages = []
    for i in range(n):
        u = url()
        to = rnd.choice([url(), url()[5:], f"../{rnd.choice(['de', 'fr'])}/{rnd.randrange(40)}", f"{rnd.randrange(40)}", f"/de/{rnd.randrange(40)}", "#x", ""])
        markup = rnd.choice([f'<html><link href="{to}" rel="alternate Canonical">', f"<link rel=canonical href={to or 'x'}><link rel=next href=/de/1>", f"<meta content='3; URL={to or 'x'}' http-equiv=Refresh>", "<p>none</p>", f'<link rel="non-canonical" href="{to}">'])
        pages.append((i, u, markup if rnd.random() < 0.7 else None))
    return pages


@pytest.mark.parametrize("seed, forms", [(1, False), (2, True), (3, False)])
def test_alias_verdicts_agree_with_plain_ones_and_sql(spark, seed, forms):
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    duckdb = pytest.importorskip("duckdb")
    from lodestone.llm.oracles import ORACLES

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            if tag == "link" and "canonical" in a.get("rel", "").lower().split():
                self.to.append(a.get("href", ""))
            if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
                self.to.append(a["content"].split("=", 1)[1])

    pages = link_pages(seed)
    near = defaultdict(set)
    rule = lambda u: next((r for r in sorted(U.RULES, key=lambda r: -len(r[0] + r[1])) if (h := u.split("/")[2]) and (h == r[0] or h.endswith("." + r[0])) and ("/" + u.split("/", 3)[3]).startswith(r[1])), None)
    for _, u, markup in pages:
        reader = Reader()
        reader.to = []
        reader.feed(markup or "")
        host, path = u.split("/", 3)[2:]
        for t in [urljoin(u, x) for x in reader.to if x and not x.startswith("#")] + ([("canonical", host.removeprefix("www.").removeprefix("m.") + "/" + path)] if forms else []):
            near[u].add(t)
            near[t].add(u)
    got = {r.page_id: (r.verdict, r.aliased) for r in U.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), forms=forms).collect()}
    for i, u, _ in pages:
        if rule(u):
            assert got[i] == (rule(u)[2], False)
            continue
        seen, todo = {u}, [u]
        while todo:
            for t in near[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        actions = {rule(x)[2] for x in seen if isinstance(x, str) and rule(x)}
        want = "allow" if "allow" in actions else "block" if actions else None
        assert got[i] == (want or "allow", want is not None)
    assert sum(a for _, a in got.values()) >= 3
    import pandas as pd

    db = duckdb.connect()
    db.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert {r[0]: (r[4], r[5]) for r in db.sql(ORACLES["op5_url_filters"]).fetchall()} == got


def test_longest_rule_wins(spark):
    rules = (("b.a", "/", "block"), ("a", "/long/path/", "allow"), ("a", "/", "allow"), ("a", "/", "block"))
    df = spark.createDataFrame([("x.b.a", "/long/path/1"), ("x.b.a", "/l"), ("a", "/"), ("ba", "/")], "h string, p string")
    got = [r[0] and (r[0].rule, r[0].action) for r in df.select(U.match_rules(F.col("h"), F.col("p"), rules)).collect()]
    assert got == [("a/long/path/", "allow"), ("b.a/", "block"), ("a/", "allow"), None]


# toxicity


def test_toxicity_held_out(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = O.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad = [r.predicted for r in rows if r.toxic]
    good = [r.predicted for r in rows if not r.toxic]
    assert sum(bad) / len(bad) > 0.7 and sum(good) / len(good) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    out = O.toxicity(edge_docs(spark), labels).collect()
    assert len(out) == len(EDGE_TEXTS) + 2 and all(0 <= r.score <= 1 for r in out)
    kept = O.drop_toxic(edge_docs(spark), labels)
    assert kept.columns == edge_docs(spark).columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert O.toxicity(edge_docs(spark).limit(0), labels.limit(0)).count() == 0


def test_toxicity_brings_only_chosen_ngrams_to_the_driver(spark, monkeypatch):
    from tests.llm.test_text_operators import labelled_texts

    rows, marks = labelled_texts(4)
    frame, sizes = type(spark.range(0)), []
    monkeypatch.setattr(frame, "toArrow", lambda self, f=frame.toArrow: (sizes.append((out := f(self)).num_rows), out)[1])
    model = O.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert sum(sizes) == len(model["weights"]) == (model["table"] >= 0).sum() > 10


# pipeline


def test_pipeline_stages(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = Cuts(spark).cut(stage(spark, docs, data))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == before.columns
    bad = {r.doc_id for r in O.toxicity(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    every = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert set(seen["toxicity"]) == set(every) - bad
    want = plain_join([(i, every[i]) for i in seen["toxicity"]])
    assert set(seen["ngram_jaccard_join"]) == {c[1] for c in want.values()}
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(seen["benchmark_decontamination"]) == {i for i in seen["ngram_jaccard_join"] if not any(x in every[i] for x in items)}
    assert set(seen["secret_scans"]) == set(seen["benchmark_decontamination"])
    sizes = sum(len(SPACED.findall(r.text)) for r in seen["secret_scans"].values())
    taken = sum(r.taken for r in seen["mixing"].values())
    assert abs(taken - sizes) < 0.02 * sizes and all(r.repeats > 0 for r in seen["mixing"].values())
    assert pipeline.run(spark, data).count() == len(seen["mixing"])
