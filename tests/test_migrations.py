"""Stores that were written by earlier layouts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import migrations as M
from lodestone.operators.store import Store
from lodestone.versions import Versions

NOW = "2024-01-0{}T00:00:00.000Z"
FIRST = "event string, at string, id string, content string, embedding array<float>, project_id string, type string, metadata string, invalidated boolean, created_at string, updated_at string"


def first_layout(spark, path):
    """Events in one folder, without scopes, references, sessions, tags and numbers; a log without sources."""
    record = lambda i, p, at=1, event="insert", text=None: (event, NOW.format(at), i, text, None, p, "pattern" if i == "a" else None, None, False, NOW.format(at) if text else None, NOW.format(at))
    spark.createDataFrame([record("a", "p", text="one"), record("b", "p", text="two"), record("c", "q", text="three")], FIRST).coalesce(1).write.parquet(f"{path}/atom_events")
    spark.createDataFrame([record("b", "p", 2, "invalidate"), record("d", "q", 2, text="four"), record("c", "q", 3, "delete")], FIRST).coalesce(1).write.mode("append").parquet(f"{path}/atom_events")
    spark.createDataFrame([("e1", "k", 1, "upsert", "a", "ab", NOW.format(1), bytearray(b"x"))], "entry_id string, client_id string, sequence_no bigint, op string, record_id string, blinded_project_id string, ts string, payload binary").write.parquet(f"{path}/oplog")
    spark.createDataFrame([("s", "p", "o")], "subject string, predicate string, object string").write.parquet(f"{path}/kg_triples")


def state(store, project=None):
    return sorted((r.id, r.content, r.project_id, r.type, r.scope, r.metadata, r.refs, r.invalidated, r.access_count, r.session_id, r.tags, r.row_seq) for r in store.atoms(project).collect())


OLD = [("a", "one", "p", "pattern", "project", "{}", [], False, 0, None, None, 0), ("b", "two", "p", "diary", "project", "{}", [], True, 0, None, None, 0), ("d", "four", "q", "diary", "project", "{}", [], False, 0, None, None, 0)]


def test_a_store_of_the_first_layout_reads_under_the_present_one(spark, tmp_path):
    first_layout(spark, tmp_path)
    store = Store(spark, str(tmp_path))
    assert M.layout(store) == 0 and M.migrate(store) == [1, 2, 3] and M.layout(store) == 3
    assert state(store) == OLD and state(store, "q") == OLD[2:]
    log = store.log().first()
    assert (log.source, log.pushed) == ("local", False) and store.triples().first().confidence == 1.0
    files = Versions(spark, store.path).files(f"{store.path}/atom_events")
    assert files and all(f.startswith("project_id=") for f in files)
    # it can be written, marked and compacted as any other
    store.insert(spark.createDataFrame([("n", "new", "p")], "id string, content string, project_id string"), NOW.format(4))
    store.mark(spark.createDataFrame([("b",)], "id string"), "restore", NOW.format(4))
    before = state(store)
    assert [(r[0], r[7]) for r in before] == [("a", False), ("b", False), ("d", False), ("n", False)]
    store.compact()
    assert state(store) == before


def test_a_second_run_changes_nothing(spark, tmp_path):
    first_layout(spark, tmp_path)
    store = Store(spark, str(tmp_path))
    M.migrate(store)
    files = Versions(spark, store.path).files(store.path)
    assert M.migrate(store) == [] and Versions(spark, store.path).files(store.path) == files


@pytest.mark.parametrize("point", ["append", "delete", "publish"])
def test_a_step_that_dies_is_taken_again(spark, tmp_path, monkeypatch, point):
    first_layout(spark, tmp_path)
    store, calls = Store(spark, str(tmp_path)), []
    owner = Store if point == "append" else Versions
    real = getattr(owner, point)

    def dies(self, *a, **kw):
        calls.append(1)
        # of the two old files the second stays; of three records of steps the last isn't written
        if len(calls) == {"append": 1, "delete": 2, "publish": 3}[point]:
            raise RuntimeError("killed")
        return real(self, *a, **kw)

    with monkeypatch.context() as m:
        m.setattr(owner, point, dies)
        with pytest.raises(RuntimeError, match="killed"):
            M.migrate(store)
    assert M.layout(store) == 2 and M.migrate(store) == [3]
    assert state(store) == OLD and state(store, "p") == OLD[:2]


def test_steps_have_an_order_and_an_end(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), []
    steps = tuple(M.Step(k, "", lambda s, k=k: seen.append(k)) for k in (1, 2, 5))
    assert M.migrate(store, steps[:2]) == [1, 2] and M.migrate(store, steps) == [5] and seen == [1, 2, 5]
    with pytest.raises(ValueError, match="has layout 5"):
        M.migrate(store, steps[:2])
    with pytest.raises(ValueError, match="order"):
        M.migrate(store, steps[::-1])


def test_an_empty_store_and_one_of_the_present_layout(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/empty")
    assert M.migrate(store) == [1, 2, 3] and store.atoms().count() == 0
    store = Store(spark, f"{tmp_path}/present")
    store.insert(spark.createDataFrame([("n", "new", "p")], "id string, content string, project_id string"), NOW.format(4))
    before = state(store)
    assert M.migrate(store) == [1, 2, 3] and state(store) == before
    assert store.events().agg(F.count("*")).first()[0] == 1
