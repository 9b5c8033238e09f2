"""Streaming jobs: draining captured lines, folding the log, rate windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import oplog
from lodestone.operators.admin import captured
from lodestone.operators.store import Store
from lodestone.sources.spool import RelayStream


def drain(lines: DataFrame, store: Store, checkpoint: str, clock, project_id: str | None = None, once: bool = True) -> StreamingQuery:
    """Appends valid captured lines to the store; rejected ones go to a quarantine table with their status.

    At least once, made effective once: a record's id is its line's hash, and ids the
    store has are left out, so a replayed batch adds nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = clock()
        found = captured(rows, project_id, now).persist()
        try:
            good = found.where("status = 'written'").withColumn("id", F.substring("line_hash", 1, 32)).dropDuplicates(["id"])
            new = good.join(store.events().select("id"), "id", "left_anti").drop("status", "line_hash")
            store.insert(new, now)
            bad = found.where("status <> 'written'").select("status", "line_hash", F.lit(number).cast("long").alias("batch"))
            store.append("quarantine", bad, "status")
        finally:
            found.unpersist()

    w = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def pull_stream(store: Store, url: str, blinded_project_id: str, checkpoint: str, clock, peer: str = "relay", once: bool = True, **options: str) -> StreamingQuery:
    """Appends a relay's rows to the store's log, batch by batch under a checkpoint.

    Entries that the log has are left out and the store's cursor moves after a batch's rows
    are written, so a pull that is killed anywhere and started again neither loses nor repeats
    an entry.  The cursor is the store's; options are those of the relay_stream source.  once:
    until the relay is drained, else as entries come.
    """
    spark = store.spark
    spark.dataSource.register(RelayStream)

    def last() -> str:
        mine = store.cursors().where((F.col("blinded_project_id") == blinded_project_id) & (F.col("direction") == "pull") & (F.col("peer_id") == peer))
        found = mine.select("last_cursor").first()
        return (found and found[0]) or "0"

    def batch(rows: DataFrame, number: int) -> None:
        read = rows.persist()
        try:
            top = read.agg(F.max(F.col("cursor").cast("decimal(19)"))).first()[0]
            if top is None:
                return
            store.append("oplog", oplog.insert_or_ignore(store.log(), oplog.from_wire(read)))
            if int(top) > int(last()):
                store.write_cursor(blinded_project_id, "pull", peer, clock(), last_cursor=str(top))
        finally:
            read.unpersist()

    def start() -> StreamingQuery:
        stream = spark.readStream.format("relay_stream").options(**options, url=url, project=blinded_project_id, cursor=last()).load()
        w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()

    if not once:
        return start()
    # a run takes at most the pages of a batch, or what an earlier one left undone
    while True:
        query = start()
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            return query


def fold_stream(entries: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Running state of every record: replays dropped, invalidation latched, latest upsert kept.

    event_time: a timestamp column that bounds the memory of replays by a watermark;
    without it every entry is remembered.
    """
    key = ["client_id", "sequence_no"]
    once = entries.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key) if event_time else entries.dropDuplicates(key)
    up = F.col("op") == "upsert"
    return once.groupBy("blinded_project_id", "record_id").agg(F.bool_or(F.col("op") == "invalidate").alias("invalidated"), F.max_by(F.when(up, F.col("payload")), F.when(up, F.struct("ts", "entry_id"))).alias("payload"), F.count("*").alias("n_entries"))


def sessions(rows: DataFrame, at: str, gap: str = "30 minutes", delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Gap-based sessions by key, with late rows up to the delay."""
    return rows.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited(requests: DataFrame, limit: int = 1000, window_s: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Each request (token_hash, project, at) with accepted: a window begins with a key's first request.

    State is two numbers a key and goes when the watermark has passed its window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        for pdf in batches:
            pdf = pdf.sort_values("at", kind="stable")
            accepted = []
            for at in (pdf["at"].astype("int64") // {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[pdf["at"].dt.unit]).tolist():
                if start is None or at - start >= window_s:
                    start, count = at, 0
                count += 1
                accepted.append(count <= limit)
            yield pdf.assign(accepted=accepted)[["token_hash", "project", "at", "accepted"]]
        ends = (start + window_s) * 1000
        if ends > state.getCurrentWatermarkMs():
            state.update((start, count))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()

    return requests.withWatermark("at", delay).groupBy("token_hash", "project").applyInPandasWithState(step, "token_hash string, project string, at timestamp, accepted boolean", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)
