from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.adjacency import Adjacency
from lodestone.operators.store import Store

NOW = "2024-06-01T00:00:00.000Z"
FIELDS = "id long, from_atom_id string, to_atom_id string, edge_type string"


def plain_reach(edges, root, depth, types=None):
    near = {}
    for _, a, b, t in edges:
        if types is None or t in types:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen, level = {root: 0}, {root}
    for d in range(1, depth + 1):
        level = {b for a in level for b in near.get(a, ())} - set(seen)
        seen |= dict.fromkeys(level, d)
    return seen


def some_edges(n=400, seed=1):
    """A sparse random graph, a chain of ten, a hub with sixty neighbours, an edge of a node to itself, a repeated edge."""
    rnd = random.Random(seed)
    rows = [(f"n{rnd.randrange(500)}", f"n{rnd.randrange(500)}") for _ in range(n)] + [(f"c{i}", f"c{i + 1}") for i in range(10)] + [("n1", f"h{i}") for i in range(60)] + [("c0", "c0"), ("c0", "c1"), ("n1", "c0")]
    return [(i, a, b, ("blocks", "causal")[i % 2]) for i, (a, b) in enumerate(rows)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def reached(spark, table, root, depth, types=None):
    return {r.id: r.depth for r in graph.reach(table, spark.createDataFrame([(root,)], "root string"), depth, types).collect()}


def test_search_of_any_depth(spark, store):
    edges = some_edges()
    table = Adjacency(store)
    assert reached(spark, table, "n1", 2) == {"n1": 0}  # no edges, no table
    store.insert_edges(spark.createDataFrame(edges[:300], FIELDS), NOW)
    assert reached(spark, table, "n1", 3) == plain_reach(edges[:300], "n1", 3)  # no table yet
    table.build(parts=32)
    store.insert_edges(spark.createDataFrame(edges[300:], FIELDS), NOW)
    for types in (None, ["causal"]):
        assert reached(spark, table, "n1", 6, types) == plain_reach(edges, "n1", 6, types)
    assert table.extend() and not table.extend()
    assert reached(spark, table, "c10", 12) == plain_reach(edges, "c10", 12)
    assert table._new(table.versions.read()[1]) == []
    nodes, touched = graph.traverse(table, spark.createDataFrame([(x,) for x in ("c0", "c9", "zz")], "id string"), spark.createDataFrame([("n1",)], "root string"), 2)
    near = plain_reach(edges, "n1", 1)
    assert {r.id for r in touched.collect()} == {i for i, a, b, _ in edges if a in near or b in near} and {r.id for r in nodes.collect()} == {"c0"}


def test_a_level_reads_its_folders_once(spark, store):
    edges = some_edges()
    store.insert_edges(spark.createDataFrame(edges, FIELDS), NOW)
    table = Adjacency(store)
    table.build(parts=32)
    nodes = spark.createDataFrame([("c3",), ("c4",)], "a string")
    plan = table.around(nodes)._jdf.queryExecution().executedPlan().toString()
    parts = [r.part for r in table._dealt(nodes, 32).select("part").distinct().collect()]
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    rows = spark.read.parquet(f"{table.path}/{table.versions.read()[1]['tables'][0]}")
    assert rows.where(F.col("part").isin(*parts)).count() < rows.count() / 4
    assert {(r.a, r.b) for r in table.around(nodes).collect()} == {(a, b) for _, x, y, _ in edges for a, b in ((x, y), (y, x)) if a in ("c3", "c4")}


def test_an_extension_that_dies_changes_nothing(spark, store, monkeypatch):
    edges = some_edges(50)
    store.insert_edges(spark.createDataFrame(edges[:40], FIELDS), NOW)
    table = Adjacency(store)
    table.build(parts=4)
    store.insert_edges(spark.createDataFrame(edges[40:], FIELDS), NOW)
    with monkeypatch.context() as m:
        m.setattr(type(table.versions), "publish", lambda *a: (_ for _ in ()).throw(SystemExit("killed")))
        with pytest.raises(SystemExit):
            table.extend()
    assert reached(spark, table, "n1", 4) == plain_reach(edges, "n1", 4)
