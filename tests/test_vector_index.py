from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.retrieval import cosine
from lodestone.operators.store import Store
from lodestone.operators.vector_index import VectorIndex, probes_for
from lodestone.plans.search import search
from lodestone.plans.service import Service
from tests.test_retrieval import ids

T = "2024-01-{:02d}T00:00:00.000Z"
FIELDS = "id string, content string, embedding array<float>, project_id string, session_id string"


def clustered(n, dim=16, centres=24, seed=0):
    rnd = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(size=(centres, dim))
    x = c[rnd.integers(0, centres, n)] + 0.25 * rnd.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def insert(spark, store, day, x, project="p", name="a", first=0):
    rows = [(f"{name}{first + i}", f"text {i}", v.tolist(), project, f"s{i % 3}") for i, v in enumerate(x)]
    store.insert(spark.createDataFrame(rows, FIELDS).coalesce(1), T.format(day))


def which(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A store that was indexed, changed, updated and changed again; no test writes to it."""
    x = clustered(1500)
    store = Store(spark, str(tmp_path_factory.mktemp("indexed")))
    insert(spark, store, 1, x[:1000])
    insert(spark, store, 1, clustered(300, seed=5), "q", "q")
    insert(spark, store, 1, clustered(20, seed=6), "small", "m")
    index = VectorIndex(store, threshold=200)
    index.build()
    insert(spark, store, 2, x[1000:1300], first=1000)
    store.mark(which(spark, [f"a{i}" for i in range(0, 1300, 7)]), "invalidate", T.format(3), "p")
    store.mark(which(spark, [f"a{i}" for i in range(0, 1300, 11)]), "delete", T.format(3), "p")
    assert index.update()
    insert(spark, store, 4, x[1300:], first=1300)
    store.mark(which(spark, [f"a{i}" for i in range(0, 1500, 13)]), "invalidate", T.format(5), "p")
    store.mark(which(spark, [f"a{i}" for i in range(0, 1300, 14)]), "restore", T.format(6), "p")
    store.record_access(which(spark, ["a1", "a1", "a50"]), T.format(7))
    return store, index, x


def test_indexed_search_equals_the_scan_after_changes(made):
    """With all cells read, for the ids divisible by 50: inserted, invalidated, restored and deleted records included."""
    store, index, x = made
    now = store.atoms("p").where("not invalidated").cache()
    for i in range(0, 1500, 250):
        want = cosine(now, x[i].tolist(), 30)
        got = index.nearest(x[i].tolist(), "p", 30)
        assert list(map(repr, got.select(*want.columns).collect())) == list(map(repr, want.collect()))


def test_recall_and_share_read(made):
    """At the measured number of cells: recall of 0.95, from less than a third of the project's rows."""
    store, index, x = made
    now = store.atoms("p").where("not invalidated").cache()
    y = {r.id: np.array(r.embedding) for r in now.collect()}
    names, m = list(y), np.array(list(y.values()))
    meta = index.meta()
    info = index._project(meta, "p")
    assert (info.n, info.dim) == (1000, 16) and info.cells == 31
    centres = np.array([r["centroid"] for r in index._read(meta["centroids"]).where("project_id = 'p'").orderBy("cell").collect()])
    hits = queries = rows = 0
    for i in range(0, 1500, 150):
        true = {names[k] for k in np.argsort(-(m @ x[i]))[:10]}
        hits += len(true & set(ids(index.nearest(x[i].tolist(), "p", 10))))
        cells = np.argsort(-(centres @ x[i]))[: info.probes].tolist()
        rows += index._held(meta, "p", cells).count()
        queries += 1
    assert hits / (10 * queries) >= 0.95
    assert rows / queries < len(y) / 3
    plan = index._held(meta, "p", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan and "cell" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_projects_below_the_threshold_and_other_vectors_are_scanned(made):
    store, index, x = made
    assert index.state("p") == "ready" and index.state("q") == "ready" and index.state("small") == "below"
    assert index.nearest(x[0].tolist(), "small") is None and index.nearest([1.0, 0.0], "p") is None
    found = search(store.atoms("small"), "", "small", "R1", 5, vector=x[0].tolist(), index=index)
    assert ids(found) == ids(cosine(store.atoms("small"), x[0].tolist(), 5))


def test_search_asks_the_index(made, monkeypatch):
    store, index, x = made
    v, asked = x[3].tolist(), []
    real = VectorIndex.nearest
    monkeypatch.setattr(VectorIndex, "nearest", lambda self, *a, **k: asked.append(1) or real(self, *a, **k))
    for how in ({}, {"session_id": "s1"}):
        want = search(store.atoms("p"), "", "p", "R1", 20, vector=v, **how)
        got = search(store.atoms("p"), "", "p", "R1", 20, vector=v, index=index, **how)
        assert ids(got) == ids(want) and got.columns == want.columns
    assert len(asked) == 2
    monkeypatch.setenv("LODESTONE_INDEX_THRESHOLD", "7")
    service = Service(store, lambda: T.format(9), "p", embed=lambda texts: [v for _ in texts])
    assert service.index.threshold == 7 and [r["id"] for r in service.search("x", tier="R1", top_k=20, record=False)["results"]] == ids(want_all := search(store.atoms("p"), "", "p", "R1", 20, vector=v)) and want_all is not None
    assert len(asked) == 3


def test_a_build_or_update_that_dies_leaves_the_index(spark, tmp_path, monkeypatch):
    store, x = Store(spark, str(tmp_path)), clustered(120, dim=4)
    insert(spark, store, 1, x)
    index = VectorIndex(store, threshold=100)
    assert index.state("p") == "absent" and index.meta() is None and index.nearest(x[0].tolist(), "p") is None and not index.update()
    states = []

    def dies(*a):
        states.append(index.state("p"))
        raise SystemExit("killed")

    with monkeypatch.context() as m:
        m.setattr(VectorIndex, "_segment", dies)
        with pytest.raises(SystemExit):
            index.build()
    assert states == ["building"] and index.state("p") == "absent"
    index.build(cells=5)
    want = ids(index.nearest(x[0].tolist(), "p", 10))
    with monkeypatch.context() as m:
        m.setattr(VectorIndex, "_segment", dies)
        with pytest.raises(SystemExit):
            index.update()
        with pytest.raises(SystemExit):
            index.build()
    assert index.state("p") == "ready" and ids(index.nearest(x[0].tolist(), "p", 10)) == want
    store.compact()
    store.vacuum()
    store.mark(which(spark, [want[0]]), "delete", T.format(2), "p")
    assert want[0] not in ids(index.nearest(x[0].tolist(), "p", 10))
    insert(spark, store, 3, np.array([[1.0, 0.0]]), name="other")  # a vector of another length is never found
    assert index.update() and "other0" not in ids(index.nearest(x[0].tolist(), "p", 200))
    with pytest.raises(ValueError):
        index.build()
    assert index.state("p") == "ready"
    index.drop()
    assert index.meta() is None


def test_probes_grow_until_the_recall_is_met():
    order = np.array([[2, 0, 1], [1, 2, 0]])
    assert probes_for([[2, 2], [1, 1]], order, 0.9) == 1
    assert probes_for([[2, 1], [1, 1]], order, 0.75) == 1 and probes_for([[2, 1], [1, 1]], order, 0.9) == 3
    assert probes_for([[], []], order) == 3


def test_no_task_holds_a_large_project(made):
    """Groups are cut by the project's numbers, so that their size doesn't grow with it."""
    from lodestone.operators import vector_index as V

    store, _, _ = made
    rows = store.atoms("p").limit(64).withColumns({"n": F.lit(10**9).cast("long"), "dim": F.lit(64)})
    assert V._salted(rows).select("salt").distinct().count() > 50
    assert V._everywhere(rows.limit(1)).count() == 10**9 * 64 // V.GROUP_FLOATS
