"""Append-only tables and the snapshot folded from them.

Nothing is updated in place: records, invalidations, deletions, enrichments and
accesses are events, written as Parquet in a folder for each project; the current
records are an aggregate of them, over one project's folder where one is asked for.
An event's time is that of its writing, whatever created_at its record claims; events
of one time are ordered by seq, which grows with every append.

A compaction writes a base beside the events: those that still count, and the records
folded from them.  A numbered version names the base and the files that it holds, and
becomes the state by one rename (versions.Versions).  Readers fold only the events
written since, with those of the base that concern the same records.  Folding takes
least and greatest events alone, so events read twice change nothing: a compaction that
breaks off, at whatever point, loses nothing, and events written meanwhile stay.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.text import entities, keywords, tags
from lodestone.scratch import Cuts
from lodestone.versions import Versions

EVENTS = "event string, at string, seq bigint, " + S.ATOMS
ACCESSES = "atom_id string, at string"
RECORD = ("content", "embedding", "project_id", "type", "scope", "refs", "created_at", "session_id", "tags")


def snapshot(events: DataFrame, accesses: DataFrame | None = None) -> DataFrame:
    """Current records: one aggregate over the events, one over the accesses."""
    return accessed(fold(events), accesses)


def fold(events: DataFrame) -> DataFrame:
    """Current records of some events, as if never accessed.

    The first insertion gives the record, the last invalidate or restore its
    validity, the last enrichment its metadata; a deletion removes it and all before
    it, until the id is inserted again.
    """
    order = F.struct("at", "seq")
    insert, flag, enrich = F.col("event") == "insert", F.col("event").isin("invalidate", "restore"), F.col("event").isin("insert", "enrich")
    fields = F.struct(*RECORD, "row_seq")
    delete = F.col("event") == "delete"
    folded = events.groupBy("id").agg(
        F.min_by(F.when(insert, fields), F.when(insert, order)).alias("first"), F.max_by(F.when(insert, fields), F.when(insert, order)).alias("last"), F.max(F.when(insert, order)).alias("inserted"),
        F.max(F.when(flag, F.struct("at", "seq", "event"))).alias("f"), F.max_by(F.when(enrich, F.col("metadata")), F.when(enrich, order)).alias("metadata"),
        F.max("at").alias("updated_at"), F.max(F.when(delete, order)).alias("deleted"),
    )
    live = folded.where(F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted"))))
    live = live.withColumn("r", F.when(F.col("deleted").isNull(), F.col("first")).otherwise(F.col("last")))
    marked = F.col("f").isNotNull() & (F.col("deleted").isNull() | (F.struct("f.at", "f.seq") > F.col("deleted")))
    live = live.select("id", "r.*", "metadata", "updated_at", F.coalesce(marked & (F.col("f.event") == "invalidate"), F.lit(False)).alias("invalidated"))
    live = live.withColumns({"access_count": F.lit(0).cast("long"), "last_accessed": F.lit(None).cast("string")})
    return S.with_defaults(live.select(*[c.split()[0] for c in S.ATOMS.split(", ")]), "records")


def accessed(records: DataFrame, accesses: DataFrame | None) -> DataFrame:
    """Folded records with their accesses counted."""
    if accesses is None:
        return records
    read = accesses.groupBy(F.col("atom_id").alias("id")).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    counted = records.join(read, "id", "left").withColumns({"access_count": F.coalesce("_n", F.lit(0)).cast("long"), "last_accessed": F.col("_at")})
    return counted.withColumn("updated_at", F.greatest("updated_at", F.coalesce("_at", F.lit("")))).select(*records.columns)


def needed(events: DataFrame) -> DataFrame:
    """The events that fold to the same records, with whatever events may still come: the first and last insertion
    of an id, its last mark, enrichment and deletion, and its last event."""
    order, rest = F.struct("at", "seq"), [c.split()[0] for c in EVENTS.split(", ") if c.split()[0] != "id"]
    of = lambda *names: F.when(F.col("event").isin(*names), order)
    kept = {"a": (F.min_by, of("insert")), "b": (F.max_by, of("insert")), "c": (F.max_by, of("invalidate", "restore")), "d": (F.max_by, of("enrich")), "e": (F.max_by, of("delete")), "f": (F.max_by, order)}
    ends = events.groupBy("id").agg(*[by(F.when(o.isNotNull(), F.struct(*rest)), o).alias(k) for k, (by, o) in kept.items()])
    found = F.array_distinct(F.filter(F.array(*kept), lambda x: x.isNotNull()))
    return ends.select("id", F.explode(found).alias("v")).select("id", "v.*").select(*[c.split()[0] for c in EVENTS.split(", ")])


def prepared(batch: DataFrame, now: str) -> DataFrame:
    """Records to insert, from any subset of the fields: ids, defaults, extracted entities, keywords and tags.

    metadata is the extraction overlaid with the caller's own, except that enriched is
    always false at first.  A text may be of any length; the limit of the write endpoint
    (schema.MAX_CONTENT_CHARS) is that endpoint's.
    """
    have = set(batch.columns)
    c = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    null = lambda kind: F.lit(None).cast(kind)
    found_e, found_k = entities(F.col("content")), keywords(F.col("content"))
    own = F.coalesce(F.from_json(c("metadata", F.lit("{}")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    extracted = F.create_map(F.lit("entities"), F.to_json(found_e), F.lit("keywords"), F.to_json(found_k))
    kept = F.map_filter(own, lambda k, v: k != "enriched")
    merged = F.map_concat(F.map_filter(extracted, lambda k, v: ~F.map_contains_key(kept, k)), kept, F.create_map(F.lit("enriched"), F.lit("false")))
    out = batch.select(
        c("id", F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("id"), "content", c("embedding", null("array<float>")).alias("embedding"), c("project_id", null("string")).alias("project_id"),
        c("type", F.lit("diary")).alias("type"), c("scope", F.lit("project")).alias("scope"), F.to_json(merged).alias("metadata"), c("refs", F.array().cast("array<string>")).alias("refs"),
        F.lit(False).alias("invalidated"), c("created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"), c("session_id", null("string")).alias("session_id"),
        F.lit(0).cast("long").alias("access_count"), null("string").alias("last_accessed"), c("tags", tags(found_e, found_k)).alias("tags"), F.monotonically_increasing_id().alias("row_seq"),
    )
    return S.checked(out, type=S.one_of(F.col("type"), S.TYPES), scope=S.one_of(F.col("scope"), S.SCOPES), created_at=S.valid_timestamp(F.col("created_at")), content=F.col("content").isNotNull())


class Store:
    """Tables below one folder.  Writes append; reads fold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, fields: str) -> DataFrame:
        try:
            return self.spark.read.schema(fields).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], fields)
            raise

    def append(self, name: str, rows: DataFrame, by: str | None = None) -> None:
        w = rows.write.mode("append")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{name}")

    def _versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/versions")

    def _read(self, folder: str, fields: str, project_id: str | None) -> DataFrame:
        rows = self.table(folder, fields).select(*[c.split()[0] for c in fields.split(", ")])
        return rows if project_id is None else rows.where(F.col("project_id") == project_id)

    def _since(self, state: dict, project_id: str | None = None) -> DataFrame:
        """Events that the base of a version doesn't hold."""
        if not state.get("folded"):
            return self._read("atom_events", EVENTS, project_id)
        folder, held = f"{self.path}/atom_events", set(state["folded"])
        new = [f"{folder}/{f}" for f in self._versions().files(folder) if f not in held]
        if not new:
            return self.spark.createDataFrame([], EVENTS)
        rows = self.spark.read.schema(EVENTS).option("basePath", folder).parquet(*new).select(*[c.split()[0] for c in EVENTS.split(", ")])
        return rows if project_id is None else rows.where(F.col("project_id") == project_id)

    def events(self, project_id: str | None = None, version: int | None = None) -> DataFrame:
        """All events that count, or those in one project's folder."""
        _, state = self._versions().read(version)
        since = self._since(state, project_id)
        return self._read(f"{state['base']}/events", EVENTS, project_id).unionByName(since) if state else since

    def atoms(self, project_id: str | None = None, version: int | None = None) -> DataFrame:
        """Current records; version: with the base of that version, as long as it isn't vacuumed."""
        _, state = self._versions().read(version)
        since = self._since(state, project_id)
        if state:
            touched = since.select("id").distinct()
            before = self._read(f"{state['base']}/events", EVENTS, project_id).join(touched, "id", "left_semi")
            records = self._read(f"{state['base']}/records", S.ATOMS, project_id).join(touched, "id", "left_anti").unionByName(fold(before.unionByName(since)))
        else:
            records = fold(since)
        return accessed(records, self.table("access_events", ACCESSES))

    def compact(self) -> int:
        """Folds all events into a new base; the number of the version that names it.  Others may write meanwhile."""
        versions = self._versions()
        number, state = versions.read()
        folder = f"{self.path}/atom_events"
        held = versions.files(folder)
        new = [f"{folder}/{f}" for f in held if f not in set(state.get("folded", ()))]
        parts = ([self.spark.read.schema(EVENTS).option("basePath", folder).parquet(*new)] if new else []) + ([self._read(f"{state['base']}/events", EVENTS, None)] if state else [])
        if not new:
            return number
        base = f"bases/{uuid.uuid4().hex}"
        events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self.append(f"{base}/events", needed(events), "project_id")
        self.append(f"{base}/records", fold(self.table(f"{base}/events", EVENTS)), "project_id")
        return versions.publish(number, {"base": base, "folded": held})

    def vacuum(self) -> None:
        """Deletes the event files that the base holds, and older bases.  Readers of older versions must have ended."""
        versions = self._versions()
        number, state = versions.read()
        if not state:
            return
        for f in state["folded"]:
            versions.delete(f"{self.path}/atom_events/{f}")
        versions.publish(number, {"base": state["base"], "folded": []})
        for old in versions.numbers():
            if old < number:
                if (base := versions.read(old)[1]["base"]) != state["base"]:
                    versions.delete(f"{self.path}/{base}")
                versions.delete(f"{versions.path}/{old:012d}.json")

    def edges(self) -> DataFrame:
        return self.table("kg_edges", S.EDGES)

    def triples(self) -> DataFrame:
        return S.with_defaults(self.table("kg_triples", S.TRIPLES), "kg_triples")

    def log(self) -> DataFrame:
        return S.with_defaults(self.table("oplog", S.OPLOG), "oplog")

    def cursors(self) -> DataFrame:
        rows = self.table("cursors", S.CURSORS)
        key = ["blinded_project_id", "direction", "peer_id"]
        # cursors only go on, so of one time the furthest is the last
        order = F.struct("updated_at", F.col("last_cursor").cast("decimal(19)"), "last_seq")
        return rows.groupBy(*key).agg(F.max_by(F.struct("last_seq", "last_cursor", "updated_at"), order).alias("r")).select(*key, "r.*")

    def insert(self, batch: DataFrame, now: str) -> None:
        """Appends records.  Their row_seq is the time of the insertion, in nanoseconds, and then their place in the batch."""
        at, rows = time.time_ns(), prepared(batch, now)
        if not rows.isStreaming and rows.rdd.getNumPartitions() > 1:
            # places follow the partitions of the written batch, so that every reader sees the same
            rows = Cuts(self.spark).cut(rows)
            part = F.shiftright("row_seq", 33)
            sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
            before, total = {}, 0
            for p, n in sizes:
                before[p], total = total, total + n
            first = self.spark.createDataFrame(list(before.items()) or [(0, 0)], "_p long, _first long")
            rows = rows.join(F.broadcast(first), part == F.col("_p"), "left").withColumn("row_seq", F.col("_first") + F.col("row_seq") - F.shiftleft("_p", 33)).drop("_p", "_first")
        rows = rows.withColumn("row_seq", F.col("row_seq") + at)
        self.append("atom_events", rows.select(F.lit("insert").alias("event"), F.lit(now).alias("at"), F.lit(at).alias("seq"), *rows.columns), "project_id")

    def mark(self, ids: DataFrame, event: str, now: str, project_id: str | None = None) -> None:
        """Appends invalidate, restore, delete or enrich for ids (column id; for enrich also metadata).

        A mark stands in its record's folder: that of project_id, else it is looked up.
        """
        if event not in ("invalidate", "restore", "delete", "enrich"):
            raise ValueError(f"unknown event {event!r}")
        if project_id is not None:
            ids = ids.withColumn("project_id", F.lit(project_id))
        else:
            homes = self.events().where("event = 'insert'").select("id", "project_id").distinct()
            ids = ids.drop("project_id").join(homes, "id")
        have = {"id", "project_id", *(["metadata"] if event == "enrich" else [])}
        fields = [F.col(n).alias(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in (x.split(" ", 1) for x in S.ATOMS.split(", "))]
        self.append("atom_events", ids.select(F.lit(event).alias("event"), F.lit(now).alias("at"), F.lit(time.time_ns()).alias("seq"), *fields), "project_id")

    def record_access(self, ids: DataFrame, now: str) -> None:
        self.append("access_events", ids.select(F.col("id").alias("atom_id"), F.lit(now).alias("at")))

    def insert_edges(self, rows: DataFrame, now: str) -> None:
        have = set(rows.columns)
        out = rows.select((F.col("id") if "id" in have else F.xxhash64("from_atom_id", "to_atom_id", "edge_type")).alias("id"), "from_atom_id", "to_atom_id", "edge_type", *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("project_id", "metadata")], F.lit(now).alias("created_at"))
        self.append("kg_edges", S.checked(out, edge_type=S.one_of(F.col("edge_type"), S.EDGE_TYPES)))

    def insert_triples(self, rows: DataFrame, now: str) -> None:
        have = set(rows.columns)
        c = lambda n, d: (F.coalesce(F.col(n), d) if n in have else d).alias(n)
        none = F.lit(None).cast("string")
        out = rows.select((F.col("id") if "id" in have else F.xxhash64("subject", "predicate", "object")).alias("id"), "subject", "predicate", "object", c("valid_from", F.lit(now)), c("valid_to", none), c("confidence", F.lit(1.0)), c("source_ref", none), c("project_id", none), F.lit(now).alias("created_at"))
        self.append("kg_triples", S.checked(out, confidence=F.col("confidence").between(0, 1)))

    def write_cursor(self, blinded_project_id: str, direction: str, peer_id: str, now: str, last_seq: int | None = None, last_cursor: str | None = None) -> None:
        if direction not in S.DIRECTIONS:
            raise ValueError(f"unknown direction {direction!r}")
        self.append("cursors", self.spark.createDataFrame([(blinded_project_id, direction, peer_id, last_seq, last_cursor, now)], S.CURSORS))


def new_id() -> str:
    return uuid.uuid4().hex
