"""A persisted inverted index for BM25, so that a search reads postings and not texts.

Two tables: postings (project_id, term, id, positions), a folder for each project, its
files holding ranges of terms, so that a term or prefix is found by the files' bounds;
and lengths (project_id, id, length).  Ranges are cut within a term too: a frequent
term's postings are many files.  A record's text never changes under its id, so new
records are added and old postings stay; records that are gone or invalid are left out
by the candidates a search is given, and candidates that the index doesn't have yet are
read from their texts, so that it needn't be up to date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fts
from lodestone.functions.text import tokens
from lodestone.operators import retrieval
from lodestone.scratch import Cuts

POSTINGS = "project_id string, term string, id string, positions array<int>"
LENGTHS = "project_id string, id string, length int"
#: words whose postings a task holds at a time
AT_ONCE = 200_000


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each record (project_id, id, t: its words), a batch for at most AT_ONCE words, or one record's."""
    schema = pa.schema([("project_id", pa.string()), ("term", pa.string()), ("id", pa.string()), ("positions", pa.list_(pa.int32()))])
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
            part = batch.slice(at, end - at)
            at, words = end, part.column("t").flatten().dictionary_encode()
            length = pc.list_value_length(part.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
            key = row * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            which, row = pa.array(order[first]), pa.array(row[order[first]])
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order]))
            terms = words.dictionary.take(words.indices.take(which))
            yield pa.RecordBatch.from_arrays([part.column("project_id").take(row), terms, part.column("id").take(row), positions], schema=schema)


def postings(split: DataFrame) -> DataFrame:
    """Postings of records with their words (t), made where a record stands: occurrences are never shuffled."""
    return split.select("project_id", "id", "t").mapInArrow(_placed, POSTINGS)


class TextIndex:
    """An index below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, fields: str) -> DataFrame:
        try:
            return self.spark.read.schema(fields).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], fields)
            raise

    def add(self, atoms: DataFrame) -> None:
        """Indexes the records (id, project_id, content) that it doesn't have yet; rows without an id or a project are left out.

        Lengths are written last and decide what is known, so an add that failed may be
        run again; readers take each posting once.
        """
        known = self._table("lengths", LENGTHS).select("project_id", "id")
        rows = atoms.where("id is not null and project_id is not null").select("project_id", "id", "content").join(known, ["project_id", "id"], "left_anti")
        split = rows.withColumn("t", tokens(F.col("content")))
        dealt = postings(split).repartitionByRange("project_id", "term", "id").sortWithinPartitions("project_id", "term", "id")
        dealt.write.mode("append").partitionBy("project_id").parquet(f"{self.path}/postings")
        split.select("project_id", "id", F.size("t").alias("length")).write.mode("append").partitionBy("project_id").parquet(f"{self.path}/lengths")

    def scores(self, rows: DataFrame, query: str, project_id: str, strict: bool = True) -> DataFrame:
        """The rows (records of that project) that match, with score; as retrieval.bm25_scores."""
        node = fts.parse(query, strict)
        if node is None:
            return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
        found = fts.leaves(node)
        units = list(dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p, _ in found for k, w in enumerate(p.words)))
        is_unit = [F.col("term").startswith(w) if prefix else F.col("term") == w for w, prefix in units]
        any_unit = is_unit[0]
        for c in is_unit[1:]:
            any_unit = any_unit | c
        mine = self._table("postings", POSTINGS).where((F.col("project_id") == project_id) & any_unit)
        none = F.array().cast("array<int>")
        held = mine.groupBy("id").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(c, F.col("positions"))))).alias(f"_p{j}") for j, c in enumerate(is_unit)])
        lengths = self._table("lengths", LENGTHS).where(F.col("project_id") == project_id).select("id", F.col("length").alias("_length")).dropDuplicates(["id"])
        # ids first, so that no text is read where all are indexed
        late = Cuts(self.spark).cut(rows.select("id").join(lengths.select("id"), "id", "left_anti"))
        lengths = lengths.join(rows.select("id"), "id", "left_semi")

        def positions(p: fts.Phrase) -> Column:
            """Where a phrase begins: the places of its first word that the others' places, moved to the front, share."""
            at = [F.col(f"_p{units.index((w, p.prefix and k == len(p.words) - 1))}") for k, w in enumerate(p.words)]
            out = at[0]
            for k, other in enumerate(at[1:], 1):
                out = F.array_intersect(out, F.transform(other, lambda x: x - k))  # noqa: B023
            return F.coalesce(F.filter(out, lambda x: x == 0) if p.first else out, none)

        tf = [F.size(positions(p) if near is None else fts.near(near, p, positions)).alias(f"_tf{i}") for i, (p, near) in enumerate(found)]
        has = [(F.size(positions(p)) > 0).alias(f"_has{i}") for i, (p, near) in enumerate(found) if near is not None]
        counted = lengths.join(held, "id").select("id", "_length", *tf, *has)
        if not late.isEmpty():
            counted, lengths = self._with_late(rows.join(late, "id", "left_semi"), counted, lengths, found)
        wide = rows.join(counted, "id").select(*rows.columns, *[c for c in counted.columns if c != "id"])
        return retrieval.scored(wide, rows.columns, node, lengths.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean")))

    def _with_late(self, late: DataFrame, counted: DataFrame, lengths: DataFrame, found: list) -> tuple[DataFrame, DataFrame]:
        """Counts and lengths with those of records that aren't indexed, from their words."""
        words = late.select("id", tokens(F.col("content")).alias("_t"))
        own = [F.size(fts.positions(F.col("_t"), p) if near is None else fts.near_positions(F.col("_t"), near, p)).alias(f"_tf{i}") for i, (p, near) in enumerate(found)]
        own += [(fts.occurrences(F.col("_t"), p) > 0).alias(f"_has{i}") for i, (p, near) in enumerate(found) if near is not None]
        more = Cuts(self.spark).cut(words.select("id", F.size("_t").alias("_length"), *own))
        return counted.unionByName(more), lengths.unionByName(more.select("id", "_length"))

    def search(self, rows: DataFrame, query: str, project_id: str, top_k: int | None = 10, strict: bool = True) -> DataFrame:
        return retrieval.ranked(self.scores(rows, query, project_id, strict).withColumn("tier", F.lit("R2")), top_k)
