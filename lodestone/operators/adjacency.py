"""Edges by node, both ways, so that a search reads those of its frontier alone.

A table with a row for either end of each edge, in folders by ranges of the node's hash.
A level of a search names the folders in which its nodes are and reads no others.  The
table is derived from a store's edges: versions name the edge files it holds, and edges
written since are read beside it, so that it never lags behind; extend adds them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.operators.store import Store
from lodestone.versions import Versions

ROWS = "a string, b string, edge_type string, id bigint, part int"
#: rows of a folder, about
PART_ROWS, MOST_PARTS = 1_000_000, 4096


def both_ways(edges: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
    """(a, b, edge_type, id): each edge seen from either end, from one scan."""
    e = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    end = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "edge_type", "id")
    return e.select(F.inline(F.array(end("from_atom_id", "to_atom_id"), end("to_atom_id", "from_atom_id"))))


class Adjacency:
    def __init__(self, store: Store, path: str | None = None):
        self.store, self.spark, self.path = store, store.spark, (path or f"{store.path}/adjacency").rstrip("/")
        self.versions, self.source = Versions(self.spark, f"{self.path}/versions"), f"{store.path}/kg_edges"

    def _dealt(self, rows: DataFrame, parts: int) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"))

    def _new(self, state: dict) -> list[str]:
        held = set(state.get("held", ()))
        return [f for f in self.versions.files(self.source) if f not in held]

    def build(self, parts: int | None = None) -> None:
        """Deals all edges anew; parts: how many folders, else by their number."""
        number, _ = self.versions.read()
        held = self.versions.files(self.source)
        rows = both_ways(self._edges(held))
        parts = parts or max(16, min(MOST_PARTS, -(-rows.count() // PART_ROWS)))
        self._publish(number, {"parts": parts, "tables": []}, rows, held)

    def extend(self) -> bool:
        """Adds the edges written since; False if there are none, or no table."""
        number, state = self.versions.read()
        new = self._new(state) if state else []
        if new:
            self._publish(number, state, both_ways(self._edges(new)), sorted([*state["held"], *new]))
        return bool(new)

    def _publish(self, number: int, state: dict, rows: DataFrame, held: list[str]) -> None:
        name = f"tables/{uuid.uuid4().hex}"
        # a node's edges may be very many: its folder's rows are dealt on by the other end
        self._dealt(rows, state["parts"]).repartition("part", F.pmod(F.xxhash64("b"), F.lit(4))).sortWithinPartitions("part", "a").write.partitionBy("part").parquet(f"{self.path}/{name}")
        self.versions.publish(number, {"parts": state["parts"], "held": held, "tables": [*state["tables"], name]})

    def _edges(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(S.EDGES).parquet(*[f"{self.source}/{f}" for f in files]) if files else self.spark.createDataFrame([], S.EDGES)

    def around(self, nodes: DataFrame, edge_types: list[str] | None = None) -> DataFrame:
        """(a, b, edge_type, id) of edges at nodes (column a, written before: it is asked twice), from the folders they are in."""
        _, state = self.versions.read()
        found = both_ways(self._edges(self._new(state)))
        if state:
            # at most MOST_PARTS numbers
            parts = [r["part"] for r in self._dealt(nodes.select("a"), state["parts"]).select("part").distinct().collect()]
            for name in state["tables"]:
                rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/{name}").where(F.col("part").isin(*parts) if parts else F.lit(False))
                found = found.unionByName(rows.drop("part"))
        if edge_types:
            found = found.where(F.col("edge_type").isin(*edge_types))
        return found.join(nodes.select("a").distinct(), "a", "left_semi")
