"""Typed graph: breadth-first search over edges, undirected, a join for each level.

Each level is written before the next one is joined, so that edges are read once for a
level, whatever the depth, and frontier and visited nodes stay distributed.  With an
adjacency table a level reads only the folders that its nodes are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.adjacency import Adjacency, both_ways
from lodestone.scratch import Cuts


def reach(edges: DataFrame | Adjacency, roots: DataFrame, max_depth: int = 2, edge_types: list[str] | None = None) -> DataFrame:
    """(root, id, depth) of every node within max_depth of a root, the root itself at depth 0.

    roots has a column root.  Known edges of ids, not paths, are kept, so cycles and
    diamonds don't multiply rows.
    """
    cuts = Cuts(roots.sparkSession)
    seen = level = cuts.cut(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())
    for d in range(1, max_depth + 1):
        nodes = level.select("root", F.col("id").alias("a"))
        near = edges.around(nodes, edge_types) if isinstance(edges, Adjacency) else both_ways(edges, edge_types)
        found = nodes.join(near.select("a", "b"), "a").select("root", F.col("b").alias("id")).distinct()
        level = cuts.cut(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def connected(edges: DataFrame | Adjacency, atoms: DataFrame, root: str, max_depth: int = 2, edge_types: list[str] | None = None, strict_scope: str | None = None) -> DataFrame:
    """Records within max_depth of a record, itself left out; strict_scope keeps one project's valid records only."""
    if max_depth < 1:
        return atoms.where(F.lit(False))
    spark = atoms.sparkSession
    found = reach(edges, spark.createDataFrame([(root,)], "root string"), max_depth, edge_types).where("depth > 0").select("id")
    out = atoms.join(found, "id", "left_semi")
    return out.where((F.col("project_id") == strict_scope) & ~F.col("invalidated")) if strict_scope else out


def traverse(edges: DataFrame | Adjacency, atoms: DataFrame, roots: DataFrame, max_depth: int = 2, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the subgraph around some roots (column root); edges are those of every node expanded."""
    table, edges = (edges, edges.store.edges()) if isinstance(edges, Adjacency) else (None, edges)
    if max_depth < 1:
        return atoms.where(F.lit(False)), edges.where(F.lit(False))
    found = reach(edges if table is None else table, roots, max_depth, edge_types)
    nodes = atoms.join(found.select("id").distinct(), "id", "left_semi")
    inner = found.where(F.col("depth") < max_depth).select(F.col("id").alias("a")).distinct()
    near = table.around(inner, edge_types) if table is not None else both_ways(edges, edge_types).join(inner, "a", "left_semi")
    return nodes, edges.join(near.select("id").distinct(), "id", "left_semi")


def valid_at(triples: DataFrame, at: str) -> DataFrame:
    """Triples that hold at a time (text order of ISO times)."""
    return triples.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def expand(results: DataFrame, atoms: DataFrame, edges: DataFrame | Adjacency, top_k: int, depth: int = 1, seeds: int = 3, decay: float = 0.7) -> DataFrame:
    """Results and what is connected to the best few of them, at a decayed score; best score by record, then top-k.

    Seeds are a top-k of three rows; their neighbourhoods are joined, not looked up one
    by one.  The results are written first, so that the search below them runs once.
    """
    from lodestone.operators.retrieval import ranked

    results = Cuts(atoms.sparkSession).cut(results)
    best = ranked(results, seeds).select(F.col("id").alias("root"), F.col("score").alias("_s"), F.col("tier").alias("_t"))
    near = reach(edges, best.select("root"), depth).where("depth > 0").join(best, "root")
    extra = near.groupBy("id").agg(F.max(F.col("_s") * decay).alias("score"), F.first("_t").alias("tier"))
    more = atoms.join(extra, "id").select(*results.columns)
    both = results.withColumn("_own", F.lit(1)).unionByName(more.withColumn("_own", F.lit(0)))
    once = both.groupBy("id").agg(F.max_by(F.struct(*results.columns), F.struct("score", "_own")).alias("r")).select("r.*")
    return ranked(once, top_k)
