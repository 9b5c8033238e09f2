from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.operators import oplog, relay, sync
from lodestone.operators.store import Store

BP = "a" * 64
NAMES = [c.split()[0] for c in S.OPLOG.split(", ")]
NOW = "2024-06-01T00:00:00.000Z"


def entry(client, seq, record="r", op="upsert", ts="2024-01-01T00:00:00Z", payload=None, **kw):
    row = dict(entry_id=hashlib.sha256(f"{client}:{seq}".encode()).hexdigest(), client_id=client, sequence_no=seq, op=op, record_id=record, blinded_project_id=BP, ts=ts, payload=(payload or f"{client}{seq}").encode(), source="local", pushed=False)
    return tuple({**row, **kw}[n] for n in NAMES)


def log(spark, rows):
    return spark.createDataFrame(rows, S.OPLOG)


def state(df):
    return {r.record_id: (r.invalidated, r.tombstone, bytes(r.payload).decode()) for r in oplog.fold(df).collect()}


def test_latest_upsert_wins_and_invalidation_latches(spark):
    rows = [entry("a", 1, ts="2024-01-01T00:00:00Z"), entry("b", 1, ts="2024-01-02T00:00:00Z"), entry("c", 1, op="invalidate", ts="2023-01-01T00:00:00Z"), entry("d", 1, "only", "invalidate", "2024-05-01T00:00:00Z"), entry("d", 2, "only", "invalidate", "2024-04-01T00:00:00Z")]
    assert state(log(spark, rows)) == {"r": (True, False, "b1"), "only": (True, True, "d2")}


def test_times_compare_as_text(spark):
    rows = [entry("a", 1, ts="2024-01-01T00:00:05Z"), entry("b", 1, ts="2024-01-01T00:00:05.678Z")]
    assert state(log(spark, rows))["r"][2] == "a1"


def test_tie_goes_to_the_larger_entry_id_and_is_a_conflict(spark):
    rows = [entry("aaa", 1), entry("zzz", 1), entry("zzz", 2, "other")]
    first, second = (hashlib.sha256(f"{c}:1".encode()).hexdigest() for c in ("aaa", "zzz"))
    assert state(log(spark, rows))["r"][2] == ("aaa1" if first > second else "zzz1")
    found = oplog.conflicts(log(spark, rows)).collect()
    assert [(r.record_id, r.winner, r.n_rivals) for r in found] == [("r", max(first, second), 1)]
    lines = [r.line for r in oplog.conflict_lines(log(spark, rows)).collect()]
    assert lines[0] == "## conflict: record_id=r" and len(lines) == 4


def test_a_report_keeps_projects_apart(spark):
    """Two projects with one record id: each gets its own winner's rivals alone."""
    rows = [entry("a", 1), entry("b", 1), entry("c", 1, ts="2023-01-01T00:00:00Z"), entry("d", 1, ts="2023-01-01T00:00:00Z")]
    whole = log(spark, rows)
    apart = whole.withColumn("blinded_project_id", F.when(F.col("client_id").isin("c", "d"), "other").otherwise(F.col("blinded_project_id")))
    lines = {}
    for r in oplog.conflict_lines(apart).collect():
        lines.setdefault(r.blinded_project_id == "other", []).append(r.line)
    assert [len(v) for v in lines.values()] == [4, 4]
    assert all("client_id=c" in x or "client_id=d" in x for x in lines[True][2:]) and all("client_id=a" in x or "client_id=b" in x for x in lines[False][2:])


def test_any_order_of_arrival_gives_the_same_state(spark):
    rnd = random.Random(5)
    rows = [entry(f"c{i % 4}", i, f"r{i % 5}", rnd.choice(["upsert", "upsert", "invalidate"]), f"2024-01-0{1 + i % 3}T00:00:00Z") for i in range(40)]
    want = state(log(spark, rows))
    for _ in range(3):
        rnd.shuffle(rows)
        assert state(log(spark, rows)) == want


def test_insert_or_ignore(spark):
    have = log(spark, [entry("a", 1)])
    batch = [(*entry("a", 1, payload="again"), 0), (*entry("a", 2, payload="first"), 1), (*entry("a", 2, payload="second"), 2), (*entry("a", 3, entry_id=entry("a", 2)[0]), 3)]
    new = oplog.insert_or_ignore(have, spark.createDataFrame(batch, S.OPLOG + ", pos int"), "pos").collect()
    assert [(r.sequence_no, bytes(r.payload)) for r in new] == [(2, b"first")]


def test_sequence_numbers_go_on(spark):
    from tests.test_retrieval import atom, atoms

    rows = atoms(spark, [atom(f"a{i}", str(i)) for i in range(30)])
    out = oplog.emit(rows, log(spark, [entry("me", 7)]), "me", BP).select("sequence_no", "op", "record_id").collect()
    assert sorted(r.sequence_no for r in out) == list(range(8, 38))
    assert oplog.next_sequence(log(spark, [entry("me", 7), entry("x", 1)])).orderBy("client_id").collect()[0].next_seq == 8


@pytest.mark.parametrize("many", [1_000_000])
def test_numbers_are_distinct_at_size(spark, many):
    """As many numbers as rows, the same for every reader, for all that deal numbers."""
    rows = spark.range(many).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("p").alias("project_id"), F.concat(F.lit("t"), (F.col("id") % 97).cast("string")).alias("created_at"))
    out = oplog.numbered(rows, ["created_at", "id"], 5, "n")
    assert out.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first() == (many, many, 5, many + 4)
    again = oplog.numbered(rows, ["created_at", "id"], 5, "m")
    assert out.join(again, "id").where("n <> m").count() == 0


def test_emitted_and_appended_numbers_are_distinct(spark):
    many = 200_000
    fields = [F.lit(None).cast(k).alias(n) for n, k in (x.split(" ", 1) for x in S.ATOMS.split(", ")) if n not in ("id", "project_id", "created_at", "invalidated")]
    made = spark.range(many).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("p").alias("project_id"), F.lit("2024").alias("created_at"), F.lit(False).alias("invalidated"), *fields)
    for out in (oplog.emit(made, log(spark, []), "me", BP), oplog.backfill(made, log(spark, []), "p", "me", BP)):
        assert out.agg(F.count("*"), F.countDistinct("sequence_no"), F.countDistinct("entry_id")).first() == (many, many, many)
    batch = oplog.emit(made, log(spark, []), "me", BP).select(*oplog.WIRE)
    added = relay.append(spark.createDataFrame([], S.RELAY), batch)
    assert added.agg(F.count("*"), F.countDistinct("ingest_seq"), F.max("ingest_seq")).first() == (many, many, many)


@pytest.mark.parametrize("cursor", ["abc", "-1", "1" * 20, "١"])
def test_a_page_wants_a_number_as_its_cursor(spark, cursor):
    with pytest.raises(ValueError):
        relay.read_page(spark.createDataFrame([], S.RELAY), BP, cursor)


def test_encrypted_payload_round_trip(spark):
    from tests.test_retrieval import atom, atoms

    key = F.lit(bytes(range(32)))
    rows = oplog.emit(atoms(spark, [atom("x", "secret text", tags=["t"])]), log(spark, []), "me", BP, key)
    assert b"secret text" not in bytes(rows.first()["payload"])
    back = oplog.replica(oplog.fold(rows), key).first()
    assert (back.id, back.content, back.tags, back.type, back.invalidated) == ("x", "secret text", ["t"], "diary", False)
    assert oplog.replica(oplog.fold(rows), F.lit(bytes(32))).first().content == ""


def test_wire_round_trip_and_receipts(spark):
    rows = log(spark, [entry("a", 1), entry("a", 2, op="invalidate", ts="2024-02-01T00:00:00Z")])
    back = oplog.from_wire(oplog.to_wire(rows))
    assert sorted(bytes(r.payload) for r in back.collect()) == [b"a1", b"a2"]
    assert {(r.source, r.pushed) for r in back.collect()} == {("remote", True)}
    got = oplog.receipts(rows, BP, "p").collect()
    assert [r.op for r in got] == ["invalidate", "write"] and got[0].record_hash == hashlib.sha256(b"r:p").hexdigest() and got[0].line.count("\t") == 2
    assert [r.op for r in oplog.receipts(rows, BP, "p", "write").collect()] == ["write"]


def test_relay_pages(spark):
    empty = spark.createDataFrame([], S.RELAY)
    rows = log(spark, [entry("a", i) for i in range(1, 8)])
    held = spark.createDataFrame(relay.append(empty, rows).collect(), S.RELAY)
    assert sorted(r.ingest_seq for r in held.collect()) == list(range(1, 8))
    assert relay.append(held, rows).count() == 0
    page = relay.read_page(held, BP, "2", 3).collect()
    assert [(r.ingest_seq, r.has_more, r.next_cursor) for r in page] == [(3, True, "5"), (4, True, "5"), (5, True, "5")]
    assert {r.has_more for r in relay.read_page(held, BP, "4", 3).collect()} == {False}
    assert relay.read_page(held, BP, "7", 3).count() == 0
    assert relay.last_cursor(held).first()[0] == "7" and relay.last_cursor(empty).first()[0] == "0"


def test_batch_rules(spark):
    w = "blinded_project_id string, op string, payload string"
    rows = [(BP, "upsert", "aGk="), ("b" * 64, "upsert", "aGk="), (BP, "drop", "aGk="), (BP, None, "aGk="), (BP, "upsert", "!"), ("x", "upsert", "aGk=")]
    got = {r.reason: r["rows"] for r in relay.check_batch(spark.createDataFrame(rows, w), BP).collect()}
    assert got == {"project mismatch": 1, "op": 2, "payload": 1, "blinded_project_id": 1}
    assert relay.check_batch(spark.createDataFrame(rows[:1] * 3, w), BP, 2).collect()[0].reason == "batch size"


@pytest.mark.parametrize("value,ok", [(None, True), ("", True), ("12", True), ("1" * 19, True), ("1" * 20, False), ("-1", False), ("x", False)])
def test_cursors(spark, value, ok):
    assert spark.createDataFrame([(value,)], "c string").select(S.valid_cursor(F.col("c"))).first()[0] is ok


def test_two_replicas_converge(spark, tmp_path):
    empty = spark.createDataFrame([], S.RELAY)
    transport = sync.MemoryRelay(empty, page=2)
    a, b = Store(spark, f"{tmp_path}/a"), Store(spark, f"{tmp_path}/b")
    a.append("oplog", log(spark, [entry("a", 1, "x"), entry("a", 2, "y", ts="2024-01-03T00:00:00Z"), entry("a", 3, "z")]))
    b.append("oplog", log(spark, [entry("b", 1, "x", "invalidate"), entry("b", 2, "y")]))
    for store, client in ((a, "a"), (b, "b"), (a, "a")):
        assert sync.sync_now(store, transport, BP, client, NOW).status == "ok"
    assert state(a.log()) == state(b.log()) and state(a.log())["x"][0] is True
    again = sync.sync_now(a, transport, BP, "a", NOW)
    assert (again.pulled, again.pushed) == (0, 0)


def test_sync_never_raises(spark, tmp_path):
    class Broken:
        def pull(self, *a):
            raise OSError("down")

    store = Store(spark, str(tmp_path))
    assert sync.sync_now(store, None, None, "a", NOW).status == "never_configured"
    assert sync.sync_now(store, Broken(), BP, "a", NOW).status == "offline"
    assert [sync.error_detail(c) for c in (401, 413, 429, 503, 418)] == ["unauthorized", "rejected", "retry", "retry", "unexpected"]


def test_relay_as_data_source(spark):
    import base64
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lodestone.sources.spool import RelayPull

    rows = [dict(zip(("entry_id", "client_id", "sequence_no", "op", "record_id", "blinded_project_id", "ts", "payload"), (f"e{i}", "a", i, "upsert", "r", BP, "t", base64.b64encode(b"x").decode()), strict=True)) for i in range(1, 6)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(self.path.rpartition("=")[2])
            page = rows[at : at + 2]
            body = json.dumps({"entries": page, "cursor": str(at + len(page)), "has_more": at + 2 < len(rows)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(RelayPull)
        df = spark.read.format("relay_pull").options(url=f"http://127.0.0.1:{server.server_port}", project=BP, cursor="1").load()
        assert sorted(r.entry_id for r in oplog.from_wire(df).collect()) == ["e2", "e3", "e4", "e5"]
    finally:
        server.shutdown()
