from __future__ import annotations

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.enrichment import merged
from lodestone.functions.vectors import pack_embedding, unpacked
from lodestone.operators import admin, oplog, relay
from lodestone.sources import spool

NOW = "2024-06-01T00:00:00Z"


def test_settings_file(tmp_path, monkeypatch):
    path = tmp_path / "a" / "config.json"
    assert config.read(path) == {}
    first = config.init(path, project_id="p", mode="x")
    assert config.init(path, project_id="q", mode="y") == {**first, "mode": "y"} and config.client_id(path) == first["client_id"]
    path.write_text("{broken")
    assert config.read(path) == {} and config.client_id(path) == config.client_id(path)
    path.write_text("[1]")
    assert config.read(path) == {}
    monkeypatch.setenv("LODESTONE_CLIENT_ID", "me")
    assert config.client_id(path) == "me"


def test_places_and_models(tmp_path, monkeypatch):
    for name in ("LODESTONE_STORE", "LODESTONE_MODE", "LODESTONE_MODEL"):
        monkeypatch.delenv(name, raising=False)
    assert config.store_folder("/x") == "/x" and config.store_folder().endswith(".lodestone/store")
    monkeypatch.setenv("LODESTONE_MODE", "project")
    assert config.store_folder(project_root="/r") == "/r/.lodestone/store"
    monkeypatch.setenv("LODESTONE_STORE", "/e")
    assert config.store_folder() == "/e" and config.store_folder("/x") == "/x"
    assert config.project_id(str(tmp_path)) == config.project_id(f"{tmp_path}/b/..") and len(config.project_id()) == 16
    assert config.active_model() is None
    with pytest.raises(ValueError, match="without a model"):
        config.active_dim()
    monkeypatch.setenv("LODESTONE_MODEL", "bge-m3")
    assert config.active_dim() == 1024
    monkeypatch.setenv("LODESTONE_MODEL", "bge-m4")
    with pytest.raises(ValueError, match="bge-m4"):
        config.active_model()


def test_key_order(monkeypatch):
    monkeypatch.delenv("LODESTONE_KEY", raising=False)
    cache, made = {"key:p": b"short"}, []
    derive = lambda: made.append(1) or bytes(32)
    assert config.resolve_key("p", cache, derive) == bytes(32) == config.resolve_key("p", cache, derive) and made == [1]
    monkeypatch.setenv("LODESTONE_KEY", base64.b64encode(b"k" * 32).decode())
    assert config.resolve_key("p", cache, derive) == b"k" * 32
    for wrong in ("%%%", base64.b64encode(b"k").decode()):
        monkeypatch.setenv("LODESTONE_KEY", wrong)
        with pytest.raises(ValueError, match="LODESTONE_KEY"):
            config.resolve_key("p", cache, derive)


def test_answers_are_merged_with_care(spark):
    answers = [
        '```json\n{"summary": "s", "entities": ["A", "B"], "keywords": []}\n```', '{"summary": 3, "entities": ["A", null], "keywords": ["k", 1]}',
        "not json", "[1, 2]", "", None, "```\n{}", json.dumps({"summary": "x" * 1500}), '"text"',
    ]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string").select("i", merged(F.lit('{"k": "v", "summary": "old"}'), F.col("a"), NOW).alias("m"))
    got = {r.i: r.m and json.loads(r.m) for r in rows.collect()}
    own = {"k": "v", "summary": "old", "enriched": "true", "enriched_at": NOW}
    assert got[0] == {**own, "summary": "s", "entities": '["A","B"]', "keywords": "[]"} and got[1] == own
    assert [got[i] for i in (2, 3, 4, 5, 6, 8)] == [None] * 6 and got[7] == {**own, "summary": "x" * 1000}
    empty = spark.createDataFrame([("{}",)], "a string").select(merged(F.lit(None).cast("string"), F.col("a"), NOW)).first()[0]
    assert json.loads(empty) == {"enriched": "true", "enriched_at": NOW}


def test_flush_merges_answers_and_pushes(spark, tmp_path):
    from lodestone.operators.store import Store
    from lodestone.plans.service import Service

    class Down:
        def __getattr__(self, name):
            raise OSError("no relay")

    store = Store(spark, str(tmp_path))
    store.insert(spark.createDataFrame([("a", "x", "p"), ("b", "y", "p")], "id string, content string, project_id string"), "2024-05-01T00:00:00Z")
    svc = Service(store, lambda: NOW, "p", transport=Down(), blinded_project_id="0" * 64)
    svc.start()
    answers = {"a": '{"summary": "short"}', "b": "I can't"}
    assert svc.call("flush", enrich=lambda rows: [{"id": r["id"], "answer": answers[r["id"]]} for r in rows]) == {"enriched": 1, "skipped": False, "reason": None}
    assert [r.id for r in admin.unenriched(store.atoms("p")).collect()] == ["b"]
    assert json.loads(store.atoms("p").where("id = 'a'").first().metadata)["summary"] == "short"


def test_captured_inputs_drain(spark, tmp_path):
    inputs = [
        ('{"hook_event_name": "Stop", "agent_type": "t", "content": "a\\nb\\rc", "session_id": "s9"}', "p"), ("plain TASK-12 text\nwith a line", "p"),
        ('{"hook_event_name": "Other", "summary": "", "prompt": "say \\"hi\\""}', "p"), ("x" * 100_050, "p"), (None, "p"), ("no project", None), ("none either", ""),
    ]
    lines = spool.capture_lines(spark.createDataFrame(inputs, "input string, project_id string"), NOW)
    spool.write_queue(lines, str(tmp_path / "queue"))
    read = [json.loads(r.value) for r in spool.read_queue(spark, str(tmp_path / "queue")).collect()]
    by = {r["content"][:12]: r for r in read}
    assert len(read) == 5 and by["a bc"]["source"] == "stop" and by["a bc"]["agent"] == "t" and by["a bc"]["session_id"] == "s9" and by["a bc"]["task_id"] is None
    assert by["plain TASK-1"]["task_id"] == "TASK-12" == by["plain TASK-1"]["metadata"]["task_id"] and by["plain TASK-1"]["content"] == "plain TASK-12 text with a line"
    assert by['say "hi"']["source"] == "unknown" and len(by["x" * 12]["content"]) == 100_000
    status = {r.status: r.n for r in admin.drain_counts(admin.captured(spool.read_queue(spark, str(tmp_path / "queue")), "p")).collect()}
    assert status == {"written": 4, "malformed": 1}


def test_sinks_append(spark, tmp_path):
    log = spark.createDataFrame([(f"e{i}", c, 1, "upsert", "r\n1", "b", "2024", b"x") for i, c in enumerate("ab")], "entry_id string, client_id string, sequence_no long, op string, record_id string, blinded_project_id string, ts string, payload binary")
    for _ in range(2):
        oplog.write_report(log, str(tmp_path / "report"))
        relay.write_audit(relay.audit(log, NOW, "t", "push", "200"), str(tmp_path / "audit"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(text) == 8 and text.count("## conflict: record_id=r 1") == 2
    rows = spark.read.json(str(tmp_path / "audit")).collect()
    assert [(r.entry_count, r.byte_count, r.status) for r in rows] == [(2, 2, "200")] * 2


def test_vectors_of_one_length(spark):
    rows = spark.createDataFrame([(bytearray(pack_embedding([1.0, 2.0], 2)),), (bytearray(b"1234"),), (None,)], "b binary")
    assert [r[0] for r in rows.select(unpacked(F.col("b"), 2)).collect()] == [[1.0, 2.0], None, None]


def test_push_posts_batches(spark):
    seen = []

    class Relay(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], [e["sequence_no"] for e in body["entries"]]))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Relay)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(spool.RelayPush)
        rows = spark.range(1500).coalesce(1).selectExpr("'e' as entry_id", "id as sequence_no", "'aGk=' as payload")
        rows.write.format("relay_push").mode("append").option("url", f"http://127.0.0.1:{server.server_port}").option("project", "b").option("token", "t").save()
    finally:
        server.shutdown()
    assert {x[:2] for x in seen} == {("/oplog/b", "Bearer t")} and [len(x[2]) for x in seen] == [1000, 500]
    assert sorted(n for x in seen for n in x[2]) == list(range(1500))
