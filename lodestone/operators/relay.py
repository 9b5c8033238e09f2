"""The relay's append-only log: numbered appends, cursor-paged reads, batch checks, audit, rate windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.oplog import WIRE, numbered
from lodestone.schema import MAX_BATCH_ENTRIES, MAX_PAYLOAD_BYTES, OPS, check_cursor, valid_blinded_id


def append(relay: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's new rows (by project and entry_id) with ingest_seq on from the relay's last."""
    cols = list(WIRE)
    once = batch.groupBy("blinded_project_id", "entry_id").agg(F.min_by(F.struct(*cols), F.struct("client_id", "sequence_no")).alias("r")).select("r.*")
    new = once.join(relay.select("blinded_project_id", "entry_id"), ["blinded_project_id", "entry_id"], "left_anti")
    last = relay.agg(F.coalesce(F.max("ingest_seq"), F.lit(0))).first()[0]
    return numbered(new, ["client_id", "sequence_no", "entry_id"], last + 1, "ingest_seq").select("ingest_seq", *cols)


def read_page(relay: DataFrame, blinded_project_id: str, cursor: str | None = None, limit: int = 500) -> DataFrame:
    """Up to limit rows after a cursor, in order, each with has_more and the page's next_cursor.

    Takes limit + 1 rows (a top-k, not a sort of the log) to know whether more follow.
    """
    after = check_cursor(cursor)
    rows = relay.where((F.col("blinded_project_id") == blinded_project_id) & (F.col("ingest_seq") > after)).orderBy("ingest_seq").limit(limit + 1)
    w = Window.orderBy("ingest_seq")  # over a page only
    page = rows.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    page = page.where(F.col("_n") <= limit)
    return page.withColumn("next_cursor", F.max("ingest_seq").over(Window.partitionBy()).cast("string")).drop("_n")


def last_cursor(relay: DataFrame, blinded_project_id: str | None = None) -> DataFrame:
    rows = relay if blinded_project_id is None else relay.where(F.col("blinded_project_id") == blinded_project_id)
    return rows.agg(F.coalesce(F.max("ingest_seq").cast("string"), F.lit("0")).alias("cursor"))


def rejection(path_id: str) -> Column:
    """Why a wire row may not be pushed to a project; null if it may."""
    raw = F.try_to_binary(F.col("payload"), F.lit("base64"))
    return (
        F.when(~valid_blinded_id(F.col("blinded_project_id")), "blinded_project_id")
        .when(F.col("blinded_project_id") != path_id, "project mismatch")
        .when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "op")
        .when(raw.isNull(), "payload")
        .when(F.length(raw) > MAX_PAYLOAD_BYTES, "payload size")
    )


def check_batch(batch: DataFrame, path_id: str, max_entries: int = MAX_BATCH_ENTRIES) -> DataFrame:
    """(reason, rows) of what is wrong with a push; no rows: nothing."""
    wrong = batch.select(rejection(path_id).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))
    size = batch.agg(F.count("*").alias("rows")).where(F.col("rows") > max_entries).select(F.lit("batch size").alias("reason"), "rows")
    return wrong.unionByName(size)


def audit(batch: DataFrame, ts: str, token_hash: str, op: str, status: str) -> DataFrame:
    """One audit row for each project of a batch."""
    sums = batch.groupBy("blinded_project_id").agg(F.count("*").alias("entry_count"), F.sum(F.length("payload")).alias("byte_count"))
    return sums.select(F.lit(ts).alias("ts"), F.lit(token_hash).alias("token_hash"), "blinded_project_id", F.lit(op).alias("op"), "entry_count", "byte_count", F.lit(status).alias("status"))


def write_audit(rows: DataFrame, path: str) -> None:
    """Appends audit rows to a folder of JSON lines; fields without a value are written as null."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def _windows(key: list[str], limit: int, window_s: int):
    """Over rows (key, second, n) sorted by key and second: each window is given out once it is over."""

    def run(batches):
        now, start, n = None, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if now != row[:-2] or row[-2] - start >= window_s:
                    if now is not None:
                        out.append((*now, start, n, max(0, n - limit)))
                    now, start, n = row[:-2], row[-2], 0
                n += row[-1]
            yield pd.DataFrame(out, columns=[*key, "window_start", "requests", "rejected"])
        if now is not None:
            yield pd.DataFrame([(*now, start, n, max(0, n - limit))], columns=[*key, "window_start", "requests", "rejected"])

    return run


def rate_windows(requests: DataFrame, key: list[str], at: str, limit: int = 1000, window_s: int = 3600) -> DataFrame:
    """Requests per key and window, and how many of them are over the limit.

    A window begins with a key's first request, and the next one with the first request
    after it has passed.  Requests are counted by second before their shuffle; a task
    reads its keys in order and holds one window, however many requests a key has.
    Requests without a time or with a null in their key are left out.
    """
    rows = requests.where(" and ".join(f"`{c}` is not null" for c in [*key, at]))
    seconds = rows.groupBy(*key, F.unix_timestamp(F.col(at).cast("timestamp")).alias("_second")).agg(F.count("*").alias("_n"))
    kinds = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in key)
    ordered = seconds.repartition(*key).sortWithinPartitions(*key, "_second")
    return ordered.mapInPandas(_windows(key, limit, window_s), f"{kinds}, window_start long, requests long, rejected long")
