"""Operation log: emission, insert-or-ignore, last-writer-wins folding, conflicts, receipts, wire form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import decrypt, encrypt, entry_id, record_hash
from lodestone.functions.text import one_line
from lodestone.scratch import Cuts

WIRE = ("entry_id", "client_id", "sequence_no", "op", "record_id", "blinded_project_id", "ts", "payload")
PAYLOAD_FIELDS = ("content", "id", "invalidated", "metadata", "project_id", "refs", "scope", "tags", "type")


def payload_json(columns: tuple[str, ...] = PAYLOAD_FIELDS) -> Column:
    """Canonical JSON of a record: keys in alphabetical order, no spaces."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def next_sequence(log: DataFrame) -> DataFrame:
    """(client_id, next_seq)."""
    return log.groupBy("client_id").agg((F.coalesce(F.max("sequence_no"), F.lit(0)) + 1).alias("next_seq"))


def emit(atoms: DataFrame, log: DataFrame, client_id: str, blinded_project_id: str, key: Column | None = None) -> DataFrame:
    """New log rows for records, numbered on from the client's last one.

    The batch is written once while its numbers are dealt (numbered), so no task holds
    all of it and every reader sees the same numbers.
    """
    base = log.where(F.col("client_id") == client_id).agg(F.coalesce(F.max("sequence_no"), F.lit(0))).first()[0]
    rows = numbered(atoms, ["created_at", "id"], base + 1, "sequence_no")
    plain = F.to_binary(payload_json(), F.lit("utf-8"))
    eid = entry_id(F.lit(client_id), F.col("sequence_no"))
    aad = F.to_binary(F.lit(blinded_project_id), F.lit("utf-8"))
    return rows.select(
        eid.alias("entry_id"), F.lit(client_id).alias("client_id"), "sequence_no", F.when(F.col("invalidated"), "invalidate").otherwise("upsert").alias("op"),
        F.col("id").alias("record_id"), F.lit(blinded_project_id).alias("blinded_project_id"), F.col("updated_at").alias("ts"),
        (plain if key is None else encrypt(plain, key, aad)).alias("payload"), F.lit("local").alias("source"), F.lit(False).alias("pushed"),
    )


def numbered(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """Consecutive numbers in a global order, without gathering the rows in one task.

    The rows are dealt into ranges and written with their range; the written table is
    counted (one number for each range goes to the driver) and numbered.  Counting
    and numbering the plan itself would sample other bounds each time.  Rows that are
    equal in all of the order's columns get their numbers in any order.
    """
    ranged = Cuts(df.sparkSession).cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before, total = {}, start
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not before:
        return df.withColumn(name, F.lit(start).cast("long")).where(F.lit(False))
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn(name, (F.element_at(shift, F.col("_part")) + within).cast("long")).drop("_part")


def backfill(atoms: DataFrame, log: DataFrame, project_id: str, client_id: str, blinded_project_id: str, key: Column | None = None) -> DataFrame:
    """Log rows for a project's records that the log doesn't know yet."""
    known = log.where(F.col("blinded_project_id") == blinded_project_id).select(F.col("record_id").alias("id"))
    return emit(atoms.where(F.col("project_id") == project_id).join(known, "id", "left_anti"), log, client_id, blinded_project_id, key)


def insert_or_ignore(log: DataFrame, batch: DataFrame, position: str | None = None) -> DataFrame:
    """The batch's rows that are new by (client_id, sequence_no) and by entry_id; of equal ones the first to arrive.

    position: column of the order of arrival; without it entry_id and sequence_no decide.
    """
    order = [F.col(position)] if position else [F.col("entry_id"), F.col("sequence_no")]
    cols = batch.columns
    first = lambda df, keys: df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")
    once = first(first(batch, ["client_id", "sequence_no"]), ["entry_id"])
    return once.join(log.select("client_id", "sequence_no"), ["client_id", "sequence_no"], "left_anti").join(log.select("entry_id"), "entry_id", "left_anti").select(*cols)


def entries_for_record(log: DataFrame, blinded_project_id: str, record_id: str) -> DataFrame:
    return log.where((F.col("blinded_project_id") == blinded_project_id) & (F.col("record_id") == record_id)).orderBy("ts", "entry_id")


def by_project(log: DataFrame, blinded_project_id: str, op: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; op: write or invalidate."""
    out = log.where(F.col("blinded_project_id") == blinded_project_id)
    if op is not None:
        out = out.where(F.col("op") == {"write": "upsert"}.get(op, op))
    out = out.orderBy(F.col("ts").desc(), F.col("entry_id").desc())
    return out if limit is None else out.limit(limit)


def unpushed(log: DataFrame, blinded_project_id: str, client_id: str) -> DataFrame:
    mine = (F.col("blinded_project_id") == blinded_project_id) & (F.col("client_id") == client_id) & (F.col("source") == "local") & ~F.col("pushed")
    return log.where(mine).orderBy("sequence_no")


def mark_pushed(log: DataFrame, cursors: DataFrame, client_id: str, peer: str = "relay") -> DataFrame:
    """The log with pushed set for this client's rows up to its push cursor of their project.

    The log is append-only, so the flag is derived and never written; cursors are one
    row for each project, direction and peer.
    """
    done = cursors.where((F.col("direction") == "push") & (F.col("peer_id") == peer)).groupBy("blinded_project_id").agg(F.max("last_seq").alias("_pushed"))
    mine = (F.col("client_id") == client_id) & (F.col("source") == "local") & (F.col("sequence_no") <= F.coalesce("_pushed", F.lit(0)))
    return log.join(done, "blinded_project_id", "left").withColumn("pushed", F.col("pushed") | mine).select(*log.columns)


def fold(log: DataFrame) -> DataFrame:
    """The current state of every record of a project, independent of the order of arrival.

    Invalidation latches; the latest upsert wins (by ts, then entry_id, as text); a
    record without upserts is a tombstone from its earliest invalidation.  One
    aggregate, combined before its shuffle, so a hot record stays cheap.
    """
    at = F.struct("ts", "entry_id")
    up, inv = F.col("op") == "upsert", F.col("op") == "invalidate"
    entry = F.struct("entry_id", "client_id", "ts", "payload")
    folded = log.groupBy("blinded_project_id", "record_id").agg(
        F.bool_or(inv).alias("invalidated"), F.count("*").alias("n_entries"), F.count_if(up).alias("n_upserts"),
        F.max_by(F.when(up, entry), F.when(up, at)).alias("_win"), F.min_by(F.when(inv, entry), F.when(inv, at)).alias("_dead"),
    )
    source = F.coalesce("_win", "_dead")
    return folded.select("blinded_project_id", "record_id", "invalidated", "n_entries", "n_upserts", F.col("_win").isNull().alias("tombstone"), source["entry_id"].alias("entry_id"), source["client_id"].alias("client_id"), source["ts"].alias("ts"), source["payload"].alias("payload"))


def replica(state: DataFrame, key: Column | None = None) -> DataFrame:
    """Records from folded state: the winner's payload, decrypted and read; a payload that can't be read gives nulls."""
    plain = F.col("payload") if key is None else decrypt(F.col("payload"), key, F.to_binary("blinded_project_id", F.lit("utf-8")))
    fields = "content string, project_id string, type string, scope string, metadata string, refs array<string>, tags array<string>"
    read = state.withColumn("_f", F.from_json(plain.cast("string"), fields))
    default = lambda c, v: F.coalesce(F.col(f"_f.{c}"), F.lit(v)).alias(c)
    return read.select(F.col("record_id").alias("id"), default("content", ""), F.col("_f.project_id").alias("project_id"), default("type", "diary"), default("scope", "project"), default("metadata", "{}"), F.coalesce(F.col("_f.refs"), F.array().cast("array<string>")).alias("refs"), F.col("_f.tags").alias("tags"), "invalidated", F.col("ts").alias("created_at"))


def conflicts(log: DataFrame) -> DataFrame:
    """(blinded_project_id, record_id, winner, n_rivals): another client's upsert has the winner's ts.

    Upserts are first reduced to the latest ts of each record by an aggregate; only
    those at that ts are joined back.
    """
    ups = log.where("op = 'upsert'").select("blinded_project_id", "record_id", "client_id", "entry_id", "ts")
    latest = ups.groupBy("blinded_project_id", "record_id").agg(F.max(F.struct("ts", "entry_id", "client_id")).alias("w"))
    same = ups.join(latest, ["blinded_project_id", "record_id"]).where((F.col("ts") == F.col("w.ts")) & (F.col("client_id") != F.col("w.client_id")))
    return same.groupBy("blinded_project_id", "record_id").agg(F.first("w.entry_id").alias("winner"), F.count("*").alias("n_rivals"))


def conflict_lines(log: DataFrame) -> DataFrame:
    """(blinded_project_id, record_id, line_no, line): the report's markdown, safe against line breaks and headings in its fields."""
    key = ["blinded_project_id", "record_id"]
    found = conflicts(log)
    said = lambda n, e, line: F.struct(F.lit(n).alias("n"), e.alias("e"), line.alias("line"))
    title = F.concat(F.lit("## conflict: record_id="), one_line(F.col("record_id")))
    why = F.concat(F.lit("- resolved_by: latest ts, then entry_id (winner="), one_line(F.col("winner")), F.lit(")"))
    head = found.select(*key, F.inline(F.array(said(0, F.lit(""), title), said(1, F.lit(""), why))))
    ups = log.where("op = 'upsert'").join(found.select(*key, "winner"), key)
    won = ups.where("entry_id = winner").select(*key, F.col("ts").alias("wts"), F.col("client_id").alias("wc"))
    rows = ups.join(won, key).where((F.col("ts") == F.col("wts")) & ((F.col("client_id") != F.col("wc")) | (F.col("entry_id") == F.col("winner"))))
    text = F.concat(F.lit("- entry_id="), one_line(F.col("entry_id")), F.lit(" client_id="), one_line(F.col("client_id")), F.lit(" seq="), F.col("sequence_no").cast("string"), F.lit(" ts="), one_line(F.col("ts")), F.lit(" op="), one_line(F.col("op")))
    each = rows.select(*key, F.when(F.col("entry_id") == F.col("winner"), 2).otherwise(3).alias("n"), F.col("entry_id").alias("e"), text.alias("line"))
    return head.unionByName(each).orderBy(*key, "n", "e")


def write_report(log: DataFrame, path: str) -> None:
    """Appends the conflicts' lines to a folder of text; each record's lines stand together, in their order."""
    conflict_lines(log).select("line").write.mode("append").text(path)


def to_wire(log: DataFrame) -> DataFrame:
    return log.select(*[F.base64("payload").alias("payload") if c == "payload" else F.col(c) for c in WIRE])


def from_wire(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.try_to_binary(F.col("payload"), F.lit("base64")).alias("payload") if c == "payload" else F.col(c) for c in WIRE], F.lit("remote").alias("source"), F.lit(True).alias("pushed"))


def receipts(log: DataFrame, blinded_project_id: str, project_id: str, op: str | None = None, limit: int | None = None) -> DataFrame:
    """(op, ts, record_hash, line) newest first; writes are named so."""
    rows = by_project(log, blinded_project_id, op, limit)
    name = F.when(F.col("op") == "upsert", "write").otherwise(F.col("op"))
    out = rows.select(name.alias("op"), "ts", record_hash(F.col("record_id"), F.lit(project_id)).alias("record_hash"))
    return out.withColumn("line", F.concat_ws("\t", "op", "ts", "record_hash"))
