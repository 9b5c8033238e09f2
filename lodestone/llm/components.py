"""Distributed connected components by alternating large-star and small-star rounds.

Every step is a grouped minimum (combined before the shuffle), written, and joined
back on the same key.  As both sides of that join are plain shuffles, adaptive
execution can split a vertex with very many edges over several tasks.  Edges and
labels never go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import Cuts


def _star(edges: DataFrame, large: bool, cuts: Cuts) -> DataFrame:
    """edges (a, b): for each vertex its neighbours' minimum, to which they are linked."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cuts.cut(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    joined = near.join(least, "a")
    if large:
        # one row for each edge at most; written, as a small star reads it twice
        return cuts.cut(joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, cuts: Cuts, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component, for every node of an edge.

    Edges with a null end or from a node to itself are left out, so a node with no
    other edge has no row.  No edges: no rows.  Rounds grow with the logarithm of the
    longest path; a graph that hasn't settled after most_rounds fails the run.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    e = cuts.cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    first, before = len(cuts.made) - 1, _state(e)
    for _ in range(most_rounds):
        e = cuts.cut(_star(_star(e, True, cuts), False, cuts))
        for old in range(first, len(cuts.made) - 1):  # what only this round has read
            cuts.drop(old)
        first = len(cuts.made) - 1
        now = _state(e)
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # dealt evenly, whatever the sizes of components
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return e.select(F.inline(ends)).distinct()
