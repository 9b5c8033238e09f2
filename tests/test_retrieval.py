from __future__ import annotations

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import fts
from lodestone.operators import conflicts, retrieval
from lodestone.plans import search as plan

NAMES = [c.split()[0] for c in S.ATOMS.split(", ")]


def atom(id, content="", **kw):
    base = dict(embedding=None, project_id="p", type="diary", scope="project", metadata="{}", refs=[], invalidated=False, created_at="2024-01-01T00:00:00.000Z", updated_at="2024-01-01T00:00:00.000Z", session_id=None, access_count=0, last_accessed=None, tags=None, row_seq=0)
    row = {**base, **kw, "id": id, "content": content}
    return tuple(row[n] for n in NAMES)


def atoms(spark, rows):
    return spark.createDataFrame(rows, S.ATOMS)


def ids(df):
    return [r.id for r in df.collect()]


def test_exact_orders_newest_first(spark):
    a = atoms(spark, [atom("a", "x", created_at="2024-01-01T00:00:00.000Z"), atom("b", "x", created_at="2024-01-02T00:00:00.000Z"), atom("c", "y"), atom("d", "x", created_at="2024-01-02T00:00:00.000Z", row_seq=5)])
    assert ids(retrieval.exact(a, "x")) == ["d", "b", "a"]


def test_cosine_skips_missing_and_short_vectors(spark):
    a = atoms(spark, [atom("a", embedding=[1.0, 0.0]), atom("b", embedding=[0.6, 0.8]), atom("c"), atom("d", embedding=[1.0])])
    got = retrieval.cosine(a, [1.0, 0.0]).select("id", "score").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("a", 1.0), ("b", 0.6)]


def test_bm25_worked_example(spark):
    a = atoms(spark, [atom("1", "a b"), atom("2", "a a a a c"), atom("3", "b c")])
    got = {r.id: r.score for r in retrieval.bm25(a, "a OR b", None).collect()}
    assert got == pytest.approx({"1": 2.31579e-06, "2": 1.51724e-06, "3": 1.15789e-06}, rel=1e-4)


def test_bm25_more_frequent_term_ranks_higher(spark):
    a = atoms(spark, [atom("1", "python python python programming"), atom("2", "python programming language"), atom("3", "java"), atom("4", "c"), atom("5", "go")])
    assert ids(retrieval.bm25(a, "python")) == ["1", "2"]


@pytest.mark.parametrize("bad", ["", "  ", "hello.", "a, b", "don't", "c++", "x?", "memory-safe", "(a", "a NOT", "NOT a", "a OR", '"a', "*", "-a", "b:a", "NEAR(a b, x)"])
def test_broken_queries_match_nothing(spark, bad):
    assert fts.parse(bad) is None


def _sqlite(docs, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, content)")
    con.executemany("insert into t values (?, ?)", list(docs.items()))
    try:
        return {i: -s for i, s in con.execute("select id, bm25(t) from t where t match ?", (query,))}
    except sqlite3.OperationalError:
        return {}


QUERIES = ["a", "a b", "a OR b c", "a AND b NOT c", "a NOT b AND c", "a NOT b NOT c", "a NOT b c", "(a OR b) d", "(a OR b) AND d", "d (a OR b)", "((a))", '"a b"', '"a b" OR d', "a + b", "al*", '"a al"*', "^a", "^ b OR c", "a a", "A élan", "elan", "foo_bar", "content:a", "{content}:b", "content:(a OR b)", "and a", '"" a', "NEAR(a b)", "NEAR(a b, 1)", "NEAR(a d, 2) OR c", "NEAR(a)", 'NEAR("a b" c, 3)', "not", "a NEAR b"]


def test_grammar_and_scores_agree_with_sqlite(spark):
    try:
        sqlite3.connect(":memory:").execute("create virtual table t using fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("this sqlite has no fts5")
    rnd = random.Random(3)
    words = ["a", "b", "c", "d", "alpha", "alp", "Élan", "foo_bar", "and", "not", "near", "x1"]
    docs = {str(i): " ".join(rnd.choices(words, k=rnd.randint(1, 14))) for i in range(40)}
    a = atoms(spark, [atom(i, t) for i, t in docs.items()]).cache()
    wrong = []
    for q in QUERIES:
        got = {r.id: r.score for r in retrieval.bm25(a, q, None).select("id", "score").collect()}
        want = _sqlite(docs, q)
        if set(got) != set(want) or got != pytest.approx(want, rel=1e-9):
            wrong.append((q, sorted((i, got.get(i), want.get(i)) for i in {**got, **want})[:4]))
    assert not wrong
    a.unpersist()


def test_bag_of_words_when_not_strict(spark):
    a = atoms(spark, [atom("1", "what is this?"), atom("2", "nothing")])
    assert ids(retrieval.bm25(a, "what's this, then?", strict=False)) == ["1"]


def _combined(spark, rows, **weights):
    df = atoms(spark, [atom(i, access_count=n) for i, _, _, n in rows]).join(spark.createDataFrame([(i, c, b) for i, c, b, _ in rows], "id string, _cos double, _bm double"), "id")
    return [(r.id, round(r.score, 6)) for r in retrieval.combine(df, None, **weights).collect()]


def test_fusion_worked_example(spark):
    got = _combined(spark, [("X", 1.0, 0.0, 0), ("Z", 0.5, 1.0, 0), ("Y", 0.0, 2.0, 0)], w_cos=0.6, w_bm25=0.4, w_access=0)
    assert got == [("X", 0.6), ("Z", 0.5), ("Y", 0.4)]


def test_access_boost_orders(spark):
    got = _combined(spark, [("a", None, 1.0, 50), ("b", None, 1.0, 10), ("c", None, 1.0, 0)], w_cos=0, w_bm25=0, w_access=1.0)
    assert [i for i, _ in got] == ["a", "b", "c"]
    assert dict(got)["b"] == pytest.approx(math.log(11) / math.log(51), abs=1e-6)


def test_min_max_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id int, s double")
    assert [r.s_norm for r in retrieval.min_max(df, ["s"]).orderBy("id").collect()] == [1.0, 1.0, None]
    assert retrieval.min_max(df.limit(0), ["s"]).count() == 0


def test_filters(spark):
    a = atoms(spark, [atom("a", tags=["X", "y"], session_id="s"), atom("b", tags=None, session_id="s"), atom("c", tags=["x"], invalidated=True), atom("d", tags=["z"]), atom("e", project_id="q", tags=["x"]), atom("f", tags=["x", None])])
    assert sorted(ids(retrieval.candidates(a, "p", tags=["x"]))) == ["a", "f"]
    assert ids(retrieval.candidates(a, "p", tags=[])) == []
    assert sorted(ids(retrieval.candidates(a, "p", session_id="s"))) == ["a", "b"]


def test_search_plans(spark):
    a = atoms(spark, [atom("a", "python", embedding=[1.0, 0.0]), atom("b", "java", embedding=[0.0, 1.0]), atom("g", "python", scope="global", embedding=[0.9, 0.1])])
    assert {r.tier for r in plan.search(a, "python", "p", "R1").collect()} == {"R2"}
    assert ids(plan.search(a, "python", "p", "R1", vector=[1.0, 0.0], top_k=1)) == ["a"]
    assert ids(plan.search_in_scope("global", a, "python", "p", 1, tier="R1", vector=[1.0, 0.0])) == []
    assert sorted(ids(plan.search_in_scope("all", a, "python", "p", tier="R2"))) == ["a", "g"]
    for bad in ({"tier": "R9"}, {"top_k": 0}, {"top_k": True}):
        with pytest.raises(ValueError):
            plan.search(a, "x", "p", **bad)
    with pytest.raises(ValueError):
        plan.search(a, "x", None)


def test_prime_notes(spark):
    a = atoms(spark, [atom("a", "decisions")])
    assert plan.prime(a, None)["note"] == "no project_id"
    assert plan.prime(a, "p")["note"] == "no memory yet"
    assert plan.prime(a, "p", "decisions")["note"] == "ok"
    assert plan.prime(a, "p", "decisions", top_k=-1)["note"] == "recall unavailable"


def test_conflicts(spark, monkeypatch):
    a = atoms(spark, [atom("a", "x" * 161, embedding=[1.0, 0.0]), atom("b", "short", embedding=[0.92, math.sqrt(1 - 0.92**2)]), atom("c", embedding=[0.0, 1.0]), atom("d")])
    got = {r.id: r for r in conflicts.conflicts(a, [1.0, 0.0], 0.9).collect()}
    assert set(got) == {"a", "b"} and got["a"].snippet == "x" * 160 + "…" and got["b"].snippet == "short"
    assert ids(conflicts.superseded(a, [1.0, 0.0], 0.9, "a")) == ["b"]
    for raw, want in (("0.5", 0.5), ("0", 0.92), ("1.5", 0.92), ("x", 0.92)):
        monkeypatch.setenv("LODESTONE_SIMILARITY", raw)
        assert conflicts.resolve_threshold() == want


def test_all_pairs_blocks_agree(spark):
    rnd = random.Random(1)
    rows = [atom(f"a{i}", project_id=f"p{i % 2}", embedding=[rnd.random(), rnd.random(), rnd.random()]) for i in range(60)]
    one, many = (sorted(map(tuple, conflicts.all_pairs(atoms(spark, rows), 0.9, n).select("id_a", "id_b", F.round("similarity", 6)).collect())) for n in (1000, 7))
    assert one == many and one


def _clustered(seed, n=240, dim=12, around=16):
    """Vectors near a few directions, of different lengths."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(around, dim))[rnd.integers(around, size=n)] + rnd.normal(size=(n, dim)) * 0.12
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rnd.uniform(0.7, 1.3, size=(n, 1))


@pytest.mark.parametrize("least", [0.9, 0.3, 0.0, -0.4])
def test_all_pairs_are_those_of_brute_force(spark, least):
    rows = [(f"a{i}", "p" if i % 3 else "q", [float(np.float32(v)) for v in x]) for i, x in enumerate(_clustered(2))]
    rows += [("short1", "p", [1.0, 0.5]), ("short2", "p", [1.0, 0.4]), ("zero", "p", [0.0] * 12), ("empty", "q", []), ("copy1", "p", rows[1][2]), ("copy2", "p", rows[1][2]), ("tiny", "p", [1e-3] * 12)]
    left_out = [("lost", None, rows[1][2]), ("nan", "p", [float("nan")] * 12), ("inf", "p", [float("inf")] * 12), ("none", "p", None)]
    found = {(r.id_a, r.id_b): r.similarity for r in conflicts.all_pairs(atoms(spark, [atom(i, project_id=p, embedding=v) for i, p, v in rows + left_out]), least, 50).collect()}
    want = {}
    for k, (a, p, x) in enumerate(rows):
        for b, q, y in rows[:k]:
            if p == q and len(x) == len(y):
                s = float(np.dot(np.array(np.float32(x), float), np.array(np.float32(y), float)))
                if s >= least:
                    want[min(a, b), max(a, b)] = s
    assert found.keys() == want.keys() and len(want) > 100
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_few_rows_meet_where_vectors_are_clustered(spark):
    rows = atoms(spark, [atom(f"a{i}", embedding=x.tolist()) for i, x in enumerate(_clustered(5, n=900, dim=32))])
    cells = conflicts.meetings(rows, 0.92, 100).groupBy("cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests")).collect()
    compared = sum(c.own * (c.own - 1) // 2 + c.own * c.guests for c in cells)
    assert sum(c.own for c in cells) <= 900 and compared < 0.25 * 900 * 899 / 2


def test_all_pairs_small_cells_are_few_comparisons(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = atoms(spark, [atom(f"r{i}", embedding=v.tolist()) for i, v in enumerate(x)])
    # rows of a task are bounded by task_rows, whatever cells block_rows makes
    groups = lambda n: conflicts.blocks(conflicts.meetings(rows, 0.5, 10), n).select(*conflicts.CELL, "bi", "bj").distinct().count()
    assert groups(2000) <= 40 < 200 < groups(10)
    found = [sorted((r.id_a, r.id_b) for r in conflicts.all_pairs(rows, 0.5, 10, n).collect()) for n in (2000, 9)]
    x = x.astype(np.float32).astype(float)
    assert found[0] == found[1] == sorted(tuple(sorted((f"r{i}", f"r{j}"))) for i in range(400) for j in range(i) if x[i] @ x[j] >= 0.5)


def test_all_pairs_of_nothing(spark):
    assert conflicts.all_pairs(atoms(spark, []), 0.9).collect() == []


def test_scores_need_only_the_columns_they_use(spark, data):
    from lodestone.sources import tables

    best = retrieval.bm25(retrieval.candidates(tables.atoms(spark, data), "src1"), "the").select("id", "score")
    assert "embedding:array" not in best._jdf.queryExecution().executedPlan().toString()


def test_r0_returns_every_copy(spark, tmp_path):
    from lodestone.queries import QUERIES

    spark.range(1200).selectExpr("id as doc_id", "'same text' as text", "'en' as lang", "'s' as source", "9L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["r0"](spark, str(tmp_path)).count() == 1200
