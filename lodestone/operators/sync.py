"""Replication between a store's log and a relay: push, pull, status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import oplog, relay
from lodestone.scratch import Cuts


#: pages that are compared with the log at a time
PAGES = 100


class Transport(Protocol):
    def push(self, blinded_project_id: str, rows: DataFrame) -> None: ...

    def pull(self, blinded_project_id: str, cursor: str | None) -> tuple[DataFrame, str, bool]: ...


class MemoryRelay:
    """A relay held as a DataFrame; for tests and single-process use."""

    def __init__(self, empty: DataFrame, page: int = 500):
        self.rows, self.page = empty, page

    def push(self, blinded_project_id: str, rows: DataFrame) -> None:
        new = relay.append(self.rows, rows).collect()
        if new:
            self.rows = self.rows.unionByName(self.rows.sparkSession.createDataFrame(new, self.rows.schema))

    def pull(self, blinded_project_id: str, cursor: str | None) -> tuple[DataFrame, str, bool]:
        page = relay.read_page(self.rows, blinded_project_id, cursor, self.page)
        first = page.select("next_cursor", "has_more").first()
        return page.select(*oplog.WIRE), (first[0] if first else cursor or "0"), bool(first and first[1])


def push(store, transport: Transport, blinded_project_id: str, client_id: str, now: str, peer: str = "relay") -> int:
    """Sends what the relay hasn't had from this client (by cursor); returns how many rows."""
    cursor = store.cursors().where((F.col("blinded_project_id") == blinded_project_id) & (F.col("direction") == "push") & (F.col("peer_id") == peer)).select("last_seq").first()
    last = (cursor and cursor[0]) or 0
    rows = oplog.unpushed(oplog.mark_pushed(store.log(), store.cursors(), client_id, peer), blinded_project_id, client_id).where(F.col("sequence_no") > last)
    n, top = rows.agg(F.count("*"), F.max("sequence_no")).first()
    if n:
        transport.push(blinded_project_id, rows.select(*oplog.WIRE))
        store.write_cursor(blinded_project_id, "push", peer, now, last_seq=max(last, top))
    return n


def pull(store, transport: Transport, blinded_project_id: str, now: str, peer: str = "relay", drain: bool = True) -> int:
    """Appends the relay's rows that are new here: pages are written, compared with the log PAGES at
    a time, and the cursor moves after each such round, until the relay is drained.

    State is folded from the whole log, so a pull that breaks off loses no record.
    """
    cursor = store.cursors().where((F.col("blinded_project_id") == blinded_project_id) & (F.col("direction") == "pull") & (F.col("peer_id") == peer)).select("last_cursor").first()
    at, more, taken = cursor and cursor[0], True, 0
    while more:
        cuts, pages = Cuts(store.spark), []
        while more and len(pages) < PAGES:
            rows, at, more = transport.pull(blinded_project_id, at)
            pages.append(cuts.cut(rows.withColumns({"source": F.lit("remote"), "pushed": F.lit(True)})))
            more = more and drain
        fresh = cuts.cut(oplog.insert_or_ignore(store.log(), reduce(DataFrame.unionByName, pages)))
        if n := fresh.count():
            store.append("oplog", fresh)
        taken += n
        store.write_cursor(blinded_project_id, "pull", peer, now, last_cursor=at)
    return taken


@dataclass(frozen=True)
class SyncResult:
    status: str  # ok, offline, never_configured
    pulled: int = 0
    pushed: int = 0
    detail: str | None = None


def error_detail(status: int) -> str:
    """What an HTTP status of a relay means."""
    return "unauthorized" if status == 401 else "rejected" if status in (400, 413, 422) else "retry" if status == 429 or status >= 500 else "unexpected"


def sync_now(store, transport: Transport | None, blinded_project_id: str | None, client_id: str, now: str, directions: tuple[str, ...] = ("pull", "push"), log: Callable[[str], None] = lambda m: None) -> SyncResult:
    """Pull, then push; never raises."""
    if transport is None or blinded_project_id is None:
        return SyncResult("never_configured")
    pulled = pushed = 0
    try:
        if "pull" in directions:
            pulled = pull(store, transport, blinded_project_id, now)
        if "push" in directions:
            pushed = push(store, transport, blinded_project_id, client_id, now)
    except Exception as e:
        log(f"{type(e).__name__}: {e}")
        return SyncResult("offline", pulled, pushed, error_detail(e.code) if isinstance(getattr(e, "code", None), int) else type(e).__name__)
    return SyncResult("ok", pulled, pushed)
