"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Each source gets a share of the budget by its weight; a source whose share is
more than most_epochs times its size is clamped there, and the excess goes to the
others by weight, again and again until none is above.

Every document of a source is then taken target / size times on average: the
whole part as repetitions, the fractional part by a seeded choice of whole
documents.  For that choice a source's documents are dealt by a seeded hash into
groups of a bounded number of rows.  Within a group, from the longest to the
shortest, a document is taken with the chance of the fractional part and of what
the group is behind, by a seeded number of its own, as long as the documents after
it can make up for either outcome; if they can't, the nearer outcome is taken.  So
a source's taken words miss its target by no more than a fraction of its groups'
shortest documents, and no task holds a whole source.

Edge cases: a null text has size 0; a null source is a source of its own, last in
order; repeated rows are documents each, counted before they are dealt; a source
of size 0 has target 0; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import Cuts

WORD = r"[^\x20\x09-\x0D]+"


def sized(text: str = "text"):
    """Number of words of a text, as a column."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, cuts: Cuts) -> DataFrame:
    """sources with rank: 0, 1, ... by code point, null last.

    Range partitions are ranked by themselves and moved by the counts of those before,
    of which there are as many as partitions.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    within = cuts.cut(dealt.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1))
    counts = {r["part"]: r["count"] for r in within.groupBy("part").count().collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    moved = within.withColumn("rank", (F.col("within") + (F.element_at(shift, F.col("part")) if before else 0)).cast("long"))
    return moved.drop("part", "within")


def water_fill(sources: DataFrame, cuts: Cuts, most_epochs: float = 3.0, budget: float | None = None, weights=(1.0, 2.0, 3.0)) -> DataFrame:
    """sources (source, source_size, n) with target.

    Each round is one aggregate of a few numbers; clamped sources never come back,
    since the level only rises.
    """
    every = F.array(*[F.lit(float(w)) for w in weights])
    s = ranked(sources, cuts).withColumn("weight", F.element_at(every, (F.col("rank") % len(weights) + 1).cast("int")))
    s = cuts.cut(s.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs))))
    total = s.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    budget = total if budget is None else float(budget)
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        n, used, free = s.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped:
            break
        clamped, left = n, budget - (used or 0.0)
        if not free:
            level = float("inf")
            break
        level = max(level, left / free)
    # those not above the level share what the clamped ones leave
    return s.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap")).drop("weight", "cap", "rank")


def _choose():
    """For the units (equal rows, c of them) of one group: how many of each are taken once more than the others."""

    def run(table: pa.Table) -> pa.Table:
        ratio = table.column("ratio")[0].as_py()
        size, c, h = (table.column(n).to_numpy() for n in ("size", "c", "h"))
        whole = int(ratio + 1e-12)
        share = max(0.0, ratio - whole)
        picks, behind = np.zeros(len(size), dtype=np.int64), 0.0
        order = np.lexsort((h, -size))
        rest = float((size * c).sum())
        chance = (h.astype(np.uint64) & np.uint64(0xFFFFFFFF)) / 2.0**32
        for i in order.tolist() if share > 0 else []:
            s, n = int(size[i]), int(c[i])
            if not s:
                break
            rest -= s * n
            due = behind + share * s * n
            # what the rest of the group can still make up for
            low, high = math.ceil((due - (1 - share) * rest) / s - 1e-9), math.floor((due + share * rest) / s + 1e-9)
            p = min(max(math.floor(due / s + chance[i]), low), high) if low <= high else math.floor(due / s + 0.5)
            picks[i] = min(max(p, 0), n)
            behind = due - picks[i] * s
        kept = table.select(["k", "h", "size", "source_size", "target", "c"])
        return kept.append_column("whole", pa.array(np.full(len(size), whole), pa.int64())).append_column("picks", pa.array(picks, pa.int64()))

    return run


def _decided(docs: DataFrame, key: str, text: str, source: str, most_epochs: float, budget: float | None, weights, seed: int, group_rows: int, broadcast_sources: int) -> tuple[DataFrame, Cuts]:
    """(k, h, size, source_size, target, c, whole, picks): each distinct row, how often it stands and is taken."""
    cuts = Cuts(docs.sparkSession)
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(source), F.col(text))
    rows = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), sized(text).alias("size"), h.alias("h"))
    # equal rows are one unit from here on, however many they are
    units = cuts.cut(rows.groupBy("k", "source", "size", "h").agg(F.count("*").alias("c")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.count("*").alias("n"))
    targets = cuts.cut(water_fill(sources, cuts, most_epochs, budget, weights))
    few = targets.count() <= broadcast_sources
    t = targets.withColumnRenamed("source", "s")
    joined = units.join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = joined.select("k", "h", "size", "source_size", "target", "c", ratio.alias("ratio"), F.pmod("h", F.ceil(F.col("n") / group_rows)).alias("grp"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"))
    kind = docs.schema[key].dataType.simpleString()
    return dealt.groupBy("src", "grp").applyInArrow(_choose(), f"k {kind}, h long, size long, source_size long, target double, c long, whole long, picks long"), cuts


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most_epochs: float = 3.0, budget: float | None = None, weights=(1.0, 2.0, 3.0), seed: int = 7, group_rows: int = 4000, broadcast_sources: int = 100_000) -> DataFrame:
    """(key, size, source_size, target, repeats, taken) of every document.  Only keys, sizes and hashes are shuffled."""
    units, cuts = _decided(docs, key, text, source, most_epochs, budget, weights, seed, group_rows, broadcast_sources)
    # the rows of a unit come back in pieces, those of a very large one from many tasks
    units = cuts.cut(units.withColumn("from", F.lit(0).cast("long")))
    large = units.where(F.col("c") > group_rows).withColumn("from", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(group_rows)))).repartition("k", "h", "from")
    pieces = units.where(F.col("c") <= group_rows).unionByName(large)
    last = F.least(F.col("c"), F.col("from") + group_rows) - 1
    out = pieces.withColumn("i", F.explode(F.sequence(F.col("from"), last))).withColumn("repeats", F.col("whole") + (F.col("i") < F.col("picks")).cast("long"))
    return out.select(F.col("k").alias(key), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most_epochs: float = 3.0, budget: float | None = None, weights=(1.0, 2.0, 3.0), seed: int = 7, group_rows: int = 4000, broadcast_sources: int = 100_000) -> DataFrame:
    """The documents that the mix takes, with their own columns and size, source_size, target, repeats and taken.

    Rows that are equal in key, source and text come out as one, with the repeats of
    all.  A column of the mix whose name the documents have already is called mix_...
    """
    units, cuts = _decided(docs, key, text, source, most_epochs, budget, weights, seed, group_rows, broadcast_sources)
    units = cuts.cut(units.withColumn("repeats", F.col("whole") * F.col("c") + F.col("picks")))
    names = docs.columns
    new = {c: f"mix_{c}" if c in names else c for c in ("size", "source_size", "target", "repeats", "taken")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = lambda name: F.col(f"c{names.index(name)}")
    plain = plain.withColumns({"_k": at(key), "_h": F.xxhash64(F.lit(seed), at(key), at(source), at(text))})
    chosen = units.where("repeats > 0").withColumn("taken", F.col("repeats") * F.col("size"))
    joined = plain.join(chosen.hint("shuffle_hash"), (F.col("_h") == F.col("h")) & F.col("_k").eqNullSafe(F.col("k")))
    if units.where("c > 1").limit(1).count():
        joined = joined.dropDuplicates(["_h", "_k"])
    return joined.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *[F.col(c).alias(n) for c, n in new.items()])
