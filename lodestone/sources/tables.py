"""The sample tables projected onto the data model, deterministically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import entry_id
from lodestone.functions.text import keywords
from lodestone.operators.oplog import WIRE
from lodestone.schema import EDGE_TYPES, TYPES

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records, with vectors (by id) and validity (by toxic label)."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    created = F.date_format(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=i.cast("int")), _ISO)
    toxic = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    wide = d.join(vectors, "doc_id", "left").join(toxic, "doc_id", "left").withColumn("created_at", created)
    meta = F.to_json(F.struct(F.col("lang").alias("category"), (i % 3 == 0).alias("enriched"), F.when(i % 3 == 0, F.col("created_at")).alias("enriched_at")))
    return wide.select(
        F.concat(F.lit("d"), i.cast("string")).alias("id"), F.col("text").alias("content"), "embedding", F.col("source").alias("project_id"), pick(TYPES, i).alias("type"),
        F.when(i % 10 == 0, "global").otherwise("project").alias("scope"), meta.alias("metadata"), F.array().cast("array<string>").alias("refs"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("invalidated"), "created_at", F.col("created_at").alias("updated_at"),
        F.when(i % 5 != 0, F.concat(F.lit("s"), (i % 25).cast("string"))).alias("session_id"), (i % 7).alias("access_count"), F.lit(None).cast("string").alias("last_accessed"),
        F.slice(keywords(F.col("text")), 1, 5).alias("tags"), i.alias("row_seq"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as typed edges between records."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    d = lambda c: F.concat(F.lit("d"), (F.col(c) % F.col("n")).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), d("o_orderkey").alias("from_atom_id"), d("o_custkey").alias("to_atom_id"), pick(EDGE_TYPES, F.col("o_orderkey")).alias("edge_type"), F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("string").alias("metadata"), F.date_format("o_orderdate", _ISO).alias("created_at"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    client, record = F.concat(F.lit("c"), F.col("user_id").cast("string")), F.col("event_id") % 2000
    wide = e.select("*", client.alias("client_id"), seq.alias("sequence_no"))
    return wide.select(
        "event_id", entry_id(F.col("client_id"), F.col("sequence_no")).alias("entry_id"), "client_id", "sequence_no", F.when(F.col("event_type") == "error", "invalidate").otherwise("upsert").alias("op"),
        F.concat(F.lit("r"), record.cast("string")).alias("record_id"), F.sha2(F.concat(F.lit("p"), (record % 5).cast("string")), 256).alias("blinded_project_id"),
        F.date_format(F.date_trunc("week", "ts"), _ISO).alias("ts"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).cast("binary").alias("payload"),
        F.when(F.col("user_id") % 3 == 0, "remote").otherwise("local").alias("source"), (F.col("event_id") % 4 == 0).alias("pushed"),
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log entries: 2,000 records in five projects; times cut to the week, so that some tie."""
    return _entries(spark, sf_dir).drop("event_id")


def relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a relay holds it, numbered by arrival."""
    return _entries(spark, sf_dir).select((F.col("event_id") + 1).alias("ingest_seq"), *WIRE)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as raw capture lines, some of them broken on purpose."""
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 31 + F.col("turn")
    good = F.to_json(F.struct(F.lit(1).alias("v"), F.col("role").alias("source"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project_id"), F.when(k % 4 != 0, F.lit("2024-05-06T07:08:09Z")).otherwise(F.lit("2024-13-06T07:08:09Z")).alias("ts"), F.when(k % 11 == 5, F.lit("  ")).when(k % 13 == 6, F.lit("sk-0123456789abcdef0123456789abcdef01234567")).otherwise(F.col("text")).alias("content")))
    return c.select(F.when(k % 17 == 3, F.lit("{not json")).when(k % 19 == 4, F.lit("[1, 2]")).when(k % 23 == 7, F.lit("   ")).otherwise(good).alias("value"), k.alias("k"))
