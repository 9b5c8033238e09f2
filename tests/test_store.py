from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import admin, graph
from lodestone.operators.store import Store
from lodestone.plans.service import Service
from lodestone.streaming import jobs

NOW = "2024-06-01T00:00:00.000Z"


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, t, None, None, NOW) for i, (a, b, t) in enumerate(rows)], "id long, from_atom_id string, to_atom_id string, edge_type string, project_id string, metadata string, created_at string")


def test_store_takes_texts_of_any_length(spark, tmp_path):
    s, text = Store(spark, str(tmp_path)), "word " * 30_000
    s.insert(spark.createDataFrame([("a", text, "p")], "id string, content string, project_id string"), NOW)
    s.compact()
    assert s.atoms("p").first().content == text
    with pytest.raises(Exception, match="broken rule: content"):
        s.insert(spark.createDataFrame([("b", None, "p")], "id string, content string, project_id string"), NOW)


def reached(spark, rows, start, depth, types=None):
    return {r.id: r.depth for r in graph.reach(edges(spark, rows), spark.createDataFrame([(start,)], "root string"), depth, types).collect() if r.depth}


def test_bfs_shapes(spark):
    chain = [("a", "b", "blocks"), ("b", "c", "causal"), ("c", "d", "blocks")]
    assert reached(spark, chain, "a", 1) == {"b": 1}
    assert reached(spark, chain, "c", 2) == {"b": 1, "d": 1, "a": 2}
    assert reached(spark, chain, "a", 3, ["blocks"]) == {"b": 1}
    assert reached(spark, [("a", "b", "blocks"), ("a", "c", "blocks"), ("b", "d", "blocks"), ("c", "d", "blocks")], "a", 2) == {"b": 1, "c": 1, "d": 2}
    assert reached(spark, [("a", "b", "blocks"), ("b", "c", "blocks"), ("c", "a", "blocks"), ("a", "a", "blocks")], "a", 5) == {"b": 1, "c": 1}
    assert reached(spark, chain, "nowhere", 2) == {}


def test_traverse_collects_edges_of_expanded_nodes(spark):
    from tests.test_retrieval import atom, atoms

    e = edges(spark, [("a", "b", "blocks"), ("b", "c", "blocks"), ("c", "d", "blocks"), ("b", "gone", "causal")])
    a = atoms(spark, [atom(x) for x in "abcd"])
    nodes, found = graph.traverse(e, a, spark.createDataFrame([("a",)], "root string"), 2)
    assert sorted(r.id for r in nodes.collect()) == ["a", "b", "c"] and sorted(r.id for r in found.collect()) == [0, 1, 3]
    assert graph.traverse(e, a, spark.createDataFrame([("a",)], "root string"), 0)[1].count() == 0
    assert sorted(r.id for r in graph.connected(e, a, "a", 2).collect()) == ["b", "c"]


def test_store_folds_events(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.atoms().count() == 0
    s.insert(spark.createDataFrame([("a", "Hello World alpha beta", "p", '{"enriched": "true", "k": "v"}'), ("b", "x", "p", None)], "id string, content string, project_id string, metadata string"), NOW)
    one = s.atoms().where("id = 'a'").first()
    meta = json.loads(one.metadata)
    assert one.tags[0] == "hello world" and meta["enriched"] == "false" and meta["k"] == "v" and "keywords" in meta
    which = lambda i: spark.createDataFrame([(i,)], "id string")
    s.mark(which("a"), "invalidate", "2024-06-02T00:00:00.000Z")
    assert s.atoms().where("id = 'a'").first().invalidated
    s.mark(which("a"), "restore", "2024-06-03T00:00:00.000Z")
    s.mark(which("b"), "delete", "2024-06-03T00:00:00.000Z")
    s.record_access(spark.createDataFrame([("a",), ("a",)], "id string"), "2024-06-04T00:00:00.000Z")
    rows = s.atoms().collect()
    assert [(r.id, r.invalidated, r.access_count, r.last_accessed, r.updated_at) for r in rows] == [("a", False, 2, "2024-06-04T00:00:00.000Z", "2024-06-04T00:00:00.000Z")]
    with pytest.raises(Exception, match="broken rule"):
        s.insert(spark.createDataFrame([("c", "x", "nonsense")], "id string, content string, type string"), NOW)
    s.insert_edges(spark.createDataFrame([("a", "b", "blocks")], "from_atom_id string, to_atom_id string, edge_type string"), NOW)
    s.insert_triples(spark.createDataFrame([("a", "is", "b")], "subject string, predicate string, object string"), NOW)
    assert s.edges().count() == 1 and s.triples().first().confidence == 1.0
    s.write_cursor("x", "push", "relay", "1", last_seq=3)
    s.write_cursor("x", "push", "relay", "2", last_seq=9)
    assert [r.last_seq for r in s.cursors().collect()] == [9]


FIELDS = "id string, content string, project_id string, created_at string"


def test_events_are_ordered_by_writing(spark, tmp_path):
    """Marks of one time by their order, a record dated ahead yields to later marks, a deleted id may come again."""
    s = Store(spark, str(tmp_path))
    which = lambda i: spark.createDataFrame([(i,)], "id string")
    s.insert(spark.createDataFrame([("a", "one", "p", "2999-01-01T00:00:00.000Z"), ("b", "two", "p", NOW)], FIELDS), NOW)
    s.mark(which("a"), "invalidate", "2024-06-02T00:00:00.000Z", "p")
    s.mark(which("a"), "restore", "2024-06-02T00:00:00.000Z")
    s.mark(which("b"), "restore", "2024-06-02T00:00:00.000Z")
    s.mark(which("b"), "invalidate", "2024-06-02T00:00:00.000Z", "p")
    s.mark(spark.createDataFrame([("a", "{\"k\": 1}")], "id string, metadata string"), "enrich", "2024-06-03T00:00:00.000Z")
    state = lambda: {r.id: (r.content, r.invalidated) for r in s.atoms("p").collect()}
    assert state() == {"a": ("one", False), "b": ("two", True)}
    one = s.atoms().where("id = 'a'").first()
    assert (one.metadata, one.created_at, one.updated_at) == ('{"k": 1}', "2999-01-01T00:00:00.000Z", "2024-06-03T00:00:00.000Z")
    s.insert(spark.createDataFrame([("a", "ignored", "p", NOW)], FIELDS), "2024-06-04T00:00:00.000Z")
    assert state()["a"] == ("one", False)
    s.mark(which("b"), "delete", "2024-06-05T00:00:00.000Z", "p")
    assert set(state()) == {"a"}
    s.insert(spark.createDataFrame([("b", "again", "p", NOW)], FIELDS), "2024-06-06T00:00:00.000Z")
    assert state()["b"] == ("again", False)
    before = sorted(map(repr, s.atoms().drop("row_seq").collect()))
    n = s.events().count()
    assert s.compact() == 1
    assert sorted(map(repr, s.atoms().drop("row_seq").collect())) == before and s.events().count() < n


def _state(s, project=None, version=None):
    return sorted(map(repr, s.atoms(project, version).collect()))


def _changes(spark, s, k):
    """Inserts, marks, deletions and enrichments of round k, over two projects."""
    now = f"2024-06-{k:02d}T00:00:00.000Z"
    s.insert(spark.createDataFrame([(f"r{k}_{i}", f"text {k} {i}", f"p{i % 2}", now) for i in range(6)], FIELDS).repartition(2), now)
    which = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    s.mark(which(f"r{k}_0", f"r{k}_1"), "invalidate", now)
    s.mark(which(f"r{k}_1", f"r{max(1, k - 1)}_2"), "restore", now)
    s.mark(which(f"r{k}_3", f"r{max(1, k - 1)}_4"), "delete", now)
    s.mark(spark.createDataFrame([(f"r{max(1, k - 1)}_5", f'{{"k": {k}}}')], "id string, metadata string"), "enrich", now)
    s.insert(spark.createDataFrame([(f"r{max(1, k - 1)}_4", f"again {k}", "p0", now)], FIELDS), now)


def test_compaction_changes_no_record(spark, tmp_path):
    """After each round one store is compacted, another isn't: both give the same records, whole and by project."""
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    for k in range(1, 4):
        _changes(spark, a, k)
        b.append("atom_events", a._since({}).where(F.col("at") == f"2024-06-{k:02d}T00:00:00.000Z"), "project_id")
        a.record_access(spark.createDataFrame([("r1_5",)], "id string"), "2024-07-01T00:00:00.000Z")
        b.record_access(spark.createDataFrame([("r1_5",)], "id string"), "2024-07-01T00:00:00.000Z")
        assert _state(a) == _state(b)
        assert a.compact() == 2 * k - 1 and a.compact() == 2 * k - 1  # nothing new: no version
        assert _state(a) == _state(b) and _state(a, "p1") == _state(b, "p1")
        a.vacuum()
        assert _state(a) == _state(b) and a.events().count() < b.events().count()
        assert a._since(a._versions().read()[1]).count() == 0
    assert len(list((tmp_path / "a" / "bases").iterdir())) == 1


def test_readers_pin_a_version(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    _changes(spark, s, 1)
    s.compact()
    pinned = s.atoms(version=1)
    _changes(spark, s, 2)
    s.compact()
    assert _state(s, version=1) == _state(s) and s.atoms(version=1).count() == s.atoms(version=2).count()
    assert pinned.where("id like 'r1%'").count() > 0  # planned before the second compaction, read after it


@pytest.mark.parametrize("point", ["needed", "fold", "publish"])
def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch, point):
    from lodestone.operators import store as module
    from lodestone.versions import Versions

    s = Store(spark, str(tmp_path))
    _changes(spark, s, 1)
    want = _state(s)

    def dies(*a):
        raise SystemExit("killed")

    with monkeypatch.context() as m:
        m.setattr(Versions if point == "publish" else module, point, dies)
        with pytest.raises(SystemExit):
            s.compact()
    assert _state(Store(spark, str(tmp_path))) == want
    s.compact()
    assert _state(s) == want


def test_events_written_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    from lodestone.versions import Conflict, Versions

    s, publish = Store(spark, str(tmp_path)), Versions.publish
    _changes(spark, s, 1)

    def late(self, after, state):
        with monkeypatch.context() as m:
            m.setattr(Versions, "publish", publish)
            _changes(spark, s, 2)
        return publish(self, after, state)

    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", late)
        s.compact()
    want = _state(s)
    assert {r.id for r in s.atoms().collect()} >= {"r2_0", "r2_1", "r2_2", "r2_5", "r1_4"}
    s.vacuum()
    assert _state(s) == want
    s.compact()
    assert _state(s) == want
    with pytest.raises(Conflict):
        s._versions().publish(0, {})


def test_rows_are_numbered_by_time_and_place(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = [(f"{i:04d}", "x", "p", NOW) for i in range(300)]
    s.insert(spark.createDataFrame(rows[:200], FIELDS).repartitionByRange(7, "id").sortWithinPartitions("id"), NOW)
    s.insert(spark.createDataFrame(rows[200:], FIELDS).coalesce(1), NOW)
    found = [r.row_seq for r in s.atoms().orderBy("id").collect()]
    assert found == sorted(set(found)) and found[199] - found[0] == 199 and found[299] - found[200] == 99


def test_a_project_is_read_from_its_own_folder(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.insert(spark.createDataFrame([(f"a{i}", "x", f"p{i % 3}", NOW) for i in range(9)] + [("none", "x", None, NOW)], FIELDS), NOW)
    plan = s.atoms("p1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan
    assert sorted(r.id for r in s.atoms("p1").collect()) == ["a1", "a4", "a7"] and s.atoms().count() == 10


def test_superseded_records_are_invalidated(spark, tmp_path):
    from lodestone.operators.conflicts import invalidate_superseded

    s = Store(spark, str(tmp_path))
    s.insert(spark.createDataFrame([("a", "x", "p", [1.0, 0.0]), ("b", "y", "p", [0.0, 1.0]), ("c", "z", "q", [1.0, 0.0]), ("new", "x", "p", [1.0, 0.0])], "id string, content string, project_id string, embedding array<float>"), NOW)
    assert [r.id for r in invalidate_superseded(s, [1.0, 0.0], "p", "2024-06-02T00:00:00.000Z", exclude_id="new").collect()] == ["a"]
    assert {r.id for r in s.atoms().where("invalidated").collect()} == {"a"}


def test_rate_windows_begin_with_a_request(spark):
    from lodestone.operators.relay import rate_windows

    at = lambda n: f"2024-01-01 {n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}"
    rows = [("k", at(t)) for t in (100, 100, 3000, 3699, 3700, 9000)] + [("other", at(0)), (None, at(1)), ("k", None)]
    df = spark.createDataFrame(rows, "key string, at string").withColumn("at", F.to_timestamp("at"))
    zero = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(F.unix_timestamp(F.to_timestamp("t"))).first()[0]
    out = sorted((r.key, r.window_start - zero, r.requests, r.rejected) for r in rate_windows(df, ["key"], "at", 2, 3600).collect())
    assert out == [("k", 100, 4, 2), ("k", 3700, 1, 0), ("k", 9000, 1, 0), ("other", 0, 1, 0)]
    assert rate_windows(df.limit(0), ["key"], "at").count() == 0


def test_endpoints(spark, tmp_path):
    clock = iter(f"2024-06-01T00:00:{i:02d}.000Z" for i in range(60))
    svc = Service(Store(spark, str(tmp_path)), lambda: next(clock), "p", embed=lambda ts: [[1.0, 0.0] if "python" in t else [0.0, 1.0] for t in ts], blinded_project_id="a" * 64)
    first = svc.call("write", content="python is a great language")
    assert first["conflicts"] == []
    second = svc.call("write", content="python again")
    assert [c["id"] for c in second["conflicts"]] == [first["id"]]
    assert {r["id"] for r in svc.call("search", query="python", top_k=5)["results"]} == {first["id"], second["id"]}
    assert svc.call("get", id=first["id"])["record"]["content"].startswith("python is")
    assert svc.call("get", id=first["id"], project_id="q") == {"found": False}
    assert svc.call("invalidate", id=first["id"])["invalidated"] and svc.call("invalidate", id="none") == {"found": False}
    assert len(svc.call("list")["records"]) == 1 and svc.call("stats")["invalidated"] == 1
    assert [r["op"] for r in svc.call("receipts")["receipts"]] == ["invalidate", "write", "write"]
    assert svc.call("receipts", form="text")["text"].count("\n") == 2
    assert svc.call("flush")["skipped"] is True
    assert svc.call("flush", enrich=lambda rows: [{"id": r["id"], "metadata": '{"enriched": true, "enriched_at": "2024"}'} for r in rows])["enriched"] == 1
    assert svc.call("stats")["last_flush"] == "2024"
    assert svc.call("gc", min_age_days=0, max_access=5, apply=True)["invalidated"] == 1
    assert svc.call("prime")["note"] == "no memory yet"
    assert svc.call("graph", entity=second["id"])["nodes"][0]["id"] == second["id"]
    assert svc.call("push")["status"] == "never_configured"
    for bad in (("search", {"query": "x", "top_k": 0}), ("write", {"content": " "}), ("search", {"query": "x", "project_id": "other"}), ("nothing", {}), ("gc", {"min_age_days": -1}), ("list", {"scope": "mars"})):
        assert "error" in svc.call(bad[0], **bad[1])


def lines(good):
    rec = lambda **kw: json.dumps({"v": 1, "project_id": "p", "content": "hello", "ts": "2024-05-06T07:08:09Z", **kw})
    return [rec(), rec(content="later", ts="2024-13-01T00:00:00Z"), "{bad", "[1]", "  ", rec(content=" "), rec(project_id=""), rec(project_id="q"), rec(content="sk-" + "a" * 40), rec(content="-----BEGIN RSA PRIVATE KEY-----"), rec(type="nonsense"), rec(session_id=5, content="five"), json.dumps({"project_id": "p", "content": "x" * (1 << 20)})]


def test_captured_lines(spark):
    df = spark.createDataFrame([(x,) for x in lines(True)], "value string")
    got = admin.captured(df, "p", NOW).collect()
    assert [r.status for r in got] == ["written", "written", "malformed", "malformed", "malformed", "malformed", "foreign", "secret", "secret", "malformed", "written", "malformed"]
    assert [r.created_at for r in got[:2]] == ["2024-05-06T07:08:09Z", NOW] and got[10].session_id is None
    assert {r.status: r.n for r in admin.drain_counts(admin.captured(df)).collect()}.get("foreign") is None


def test_drain_stream_is_idempotent(spark, tmp_path):
    q = tmp_path / "q"
    q.mkdir()
    (q / "1.jsonl").write_text("\n".join(lines(True)))
    s = Store(spark, f"{tmp_path}/s")
    from lodestone.sources.spool import stream_queue

    for n in range(2):
        jobs.drain(stream_queue(spark, str(q)), s, f"{tmp_path}/cp{n}", lambda: NOW, "p").awaitTermination()  # a new checkpoint replays the file
        assert sorted(r.content for r in s.atoms().collect()) == ["five", "hello", "later"]
    assert spark.read.parquet(f"{tmp_path}/s/quarantine").groupBy("status").count().count() == 3


def test_fold_stream(spark, tmp_path):
    from tests.test_log import NAMES, entry

    rows = [entry("a", 1, ts="2024-01-01"), entry("b", 1, ts="2024-01-02"), entry("c", 1, op="invalidate", ts="2023-01-01")]
    src = tmp_path / "in"
    spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(NAMES, "string string long string string string string binary string boolean".split(), strict=True))).write.parquet(str(src))
    spark.createDataFrame(rows[:2], spark.read.parquet(str(src)).schema).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    w = jobs.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    w.awaitTermination()
    assert [(r.record_id, r.invalidated, bytes(r.payload), r.n_entries) for r in spark.table("folded").collect()] == [("r", True, b"b1", 3)]


def test_rate_limit_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 't' token_hash, 'p' project, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10,0) at from range(10)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("token_hash string, project string, at timestamp").parquet(src)
    w = jobs.rate_limited(stream, 3, 3600).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    w.awaitTermination()
    got = [r.accepted for r in spark.table("limited").orderBy("at").collect()]
    assert got == [True, True, True, False, False, False, True, True, True, False]


def test_mirror_keeps_what_stands_outside(spark, tmp_path):
    from tests.test_retrieval import atom, atoms

    a = atoms(spark, [atom("b", "two\nlines", metadata='{"category": "Deploy!"}'), atom("a", "one", metadata='{"category": "deploy"}'), atom("c", "gone", invalidated=True), atom("d", "plain")])
    (tmp_path / "deploy.md").write_text("mine\n")
    assert admin.write_mirror(a, "p", str(tmp_path)) == {"deploy": 2, "notes": 1}
    want = "mine\n<!-- lodestone:start -->\n- one\n- two lines\n<!-- lodestone:end -->\n"
    assert (tmp_path / "deploy.md").read_text() == want
    admin.write_mirror(a, "p", str(tmp_path))
    assert (tmp_path / "deploy.md").read_text() == want


def test_stale_and_stats(spark):
    from tests.test_retrieval import atom, atoms

    a = atoms(spark, [atom("old", created_at="2024-01-01T00:00:00.000Z"), atom("read", created_at="2024-01-01T00:00:00.000Z", access_count=9), atom("new", created_at="2024-05-31T00:00:00.000Z", metadata='{"enriched": true, "enriched_at": 5}'), atom("off", invalidated=True, metadata='{"enriched_at": "2024"}')])
    assert [r.id for r in admin.stale(a, "2024-06-01T00:00:00", 30, 1).collect()] == ["old"]
    assert tuple(admin.stats(a).first()) == (4, 1, 3, "2024")
    assert sorted(r.id for r in admin.unenriched(a).collect()) == ["old", "read"]
    assert [r.id for r in admin.list_project(a, "p", False, 1).collect()] == ["new"]
    with pytest.raises(ValueError):
        admin.list_project(a, "p", limit=0)
    assert a.where(F.col("id") == "old").count() == 1
