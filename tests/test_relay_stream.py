"""Pulling from a relay over HTTP as a stream."""

from __future__ import annotations

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.errors import StreamingQueryException

from lodestone.operators.store import Store
from lodestone.sources import spool
from lodestone.streaming import jobs

BP, NOW = "ab" * 32, "2024-01-01T00:00:00.000Z"


class Relay:
    """A relay's log of one project: entry i has the cursor 3 * i, as other projects' entries lie between."""

    def __init__(self):
        self.entries, self.page, self.asked = [], 4, []

    def add(self, n):
        for i in range(len(self.entries), len(self.entries) + n):
            self.entries.append(dict(entry_id=f"e{i}", client_id="a", sequence_no=i, op="upsert", record_id=f"r{i}", blinded_project_id=BP, ts=NOW, payload=base64.b64encode(b"x").decode()))

    def answer(self, since):
        self.asked.append(since)
        rest = [(3 * i + 3, e) for i, e in enumerate(self.entries) if 3 * i + 3 > since]
        page = rest[: self.page]
        return {"entries": [e for _, e in page], "cursor": str(page[-1][0]) if page else str(since) if since else None, "has_more": len(rest) > len(page)}


@pytest.fixture
def relay():
    held = Relay()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            body = json.dumps(held.answer(int(parse_qs(url.query).get("since", ["0"])[0]))).encode()
            self.send_response(200 if url.path == f"/oplog/{BP}" else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    held.url = f"http://127.0.0.1:{server.server_port}"
    yield held
    server.shutdown()


def pulled(store):
    return sorted((r.entry_id for r in store.log().collect()), key=lambda e: int(e[1:]))


def run(store, relay, tmp_path, **options):
    return jobs.pull_stream(store, relay.url, BP, f"{tmp_path}/checkpoint", lambda: NOW, **{"pages": "2", **options})


def expect(relay):
    return [e["entry_id"] for e in relay.entries]


def test_a_stream_goes_on_where_it_stopped(spark, relay, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    run(store, relay, tmp_path)
    assert pulled(store) == []  # an empty relay has no cursor
    relay.add(19)
    run(store, relay, tmp_path)
    assert pulled(store) == expect(relay) and store.cursors().first().last_cursor == "57"
    relay.asked.clear()
    relay.add(3)
    run(store, relay, tmp_path)
    assert pulled(store) == expect(relay) and min(relay.asked) >= 57


@pytest.mark.parametrize("point", ["append", "write_cursor", "after"])
def test_a_killed_pull_neither_loses_nor_repeats(spark, relay, tmp_path, monkeypatch, point):
    """The second batch dies; then the relay has got more entries, and has longer pages."""
    store, calls = Store(spark, f"{tmp_path}/store"), []
    relay.add(18)
    name = "write_cursor" if point == "after" else point
    real = getattr(Store, name)

    def dies(self, *a, **kw):
        counts = name != "append" or a[0] == "oplog"
        calls.append(1) if counts else None
        if counts and len(calls) == 2:
            if point == "after":
                real(self, *a, **kw)
            raise RuntimeError("killed")
        return real(self, *a, **kw)

    with monkeypatch.context() as m:
        m.setattr(Store, name, dies)
        with pytest.raises(StreamingQueryException):
            run(store, relay, tmp_path)
    assert len(pulled(store)) == (8 if point == "append" else 16)
    relay.add(5)
    relay.page = 7
    run(store, relay, tmp_path)
    assert pulled(store) == expect(relay) and store.cursors().first().last_cursor == "69"


def test_a_batch_read_again_has_the_same_entries(relay):
    relay.add(10)
    reader = spool._RelayStreamReader({"url": relay.url, "project": BP, "pages": "9"})
    start, end = reader.initialOffset(), reader.latestOffset()
    read = lambda r, a, b: [row[0] for p in r.partitions(a, b) for row in r.read(p)]
    assert read(reader, start, end) == expect(relay) and len(reader.partitions(start, end)) == 3
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    relay.add(6)
    relay.page = 3
    later = spool._RelayStreamReader({"url": relay.url, "project": BP, "pages": "9"})
    assert read(later, start, end) == expect(relay)[:10]
    # another walk's pages, cut where this one's start lies
    middle = {"from": "0", "cursor": "15", "pages": {}}
    assert read(later, middle, end) == expect(relay)[5:10]
    assert read(later, end, later.latestOffset()) == expect(relay)[10:]


@pytest.mark.parametrize("body", [[], {"entries": None}, {"entries": [1], "cursor": "1"}, {"entries": [], "cursor": 5}, {"entries": [], "cursor": "-1"}, {"entries": [], "cursor": "1" * 20}])
def test_bad_envelopes(relay, body):
    relay.answer = lambda since: body
    with pytest.raises(ValueError, match="bad envelope"):
        spool._page({"url": relay.url, "project": BP}, "0")


def test_a_relay_that_lost_an_entry_or_stands_still(relay):
    relay.add(2)
    reader = spool._RelayStreamReader({"url": relay.url, "project": BP})
    end = reader.latestOffset()
    relay.entries.pop()
    with pytest.raises(ValueError, match="no longer has"):
        [list(reader.read(p)) for p in reader.partitions(reader._at("0"), end)]
    relay.answer = lambda since: {"entries": [{"entry_id": "e"}], "cursor": "6", "has_more": True}
    with pytest.raises(ValueError, match="move its cursor"):
        reader.latestOffset()
