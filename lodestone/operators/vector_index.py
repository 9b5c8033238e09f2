"""A maintained inverted-file vector index over a store: a project's vectors in cells around centroids.

Projects from a threshold on are indexed.  A build fits centroids for each project on a
bounded sample, puts every valid record with a vector into its cell (a folder of its
project), and measures for each project how many cells a query must read: held-out
vectors are looked up with more and more cells until RECALL of their true neighbours
are found.

The store's events are what the index lacks: a search takes the records that any event
has touched since the index's position from the store, folds those alone and ranks
them beside the cells' other records, so that insertions, marks and deletions show at
once.  An update turns those events into a further segment: cells of the records that
are valid now, and the ids whose older copies are gone.  A build starts again with one
segment.  Versions name segments, so readers see a whole update or none of it, and an
update or a build that breaks off leaves the index as it was.

An event must be readable within SLACK of the time that it carries.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.vectors import dot_literal
from lodestone.operators.retrieval import ranked
from lodestone.operators.store import ACCESSES, Store, accessed, fold
from lodestone.versions import Versions

THRESHOLD, SAMPLE_ROWS, MOST_CELLS = 30_000, 20_000, 4096
#: share of the true NEIGHBOURS that a query's cells hold at least, as measured on HELD_OUT vectors of each project
RECALL, NEIGHBOURS, HELD_OUT = 0.95, 10, 200
#: numbers of the vectors that one task holds at a time
GROUP_FLOATS = 4_000_000
#: rows of a cell's file, in a project with as many cells as there may be
CELL_ROWS = 250_000
SLACK = 3_600 * 10**9
FIELDS = [c.split()[0] for c in S.ATOMS.split(", ")]


def threshold_setting() -> int:
    """Vectors from which a project is indexed: LODESTONE_INDEX_THRESHOLD, else 30,000."""
    return int(os.environ.get("LODESTONE_INDEX_THRESHOLD", THRESHOLD))


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k unit centroids by spherical k-means."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        empty = np.bincount(cell, minlength=k) == 0
        sums[empty] = x[rnd.choice(len(x), int(empty.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def probes_for(cells: list[list[int]], order: np.ndarray, recall: float = RECALL) -> int:
    """The least number of cells, nearest first, that hold that share of the neighbours; order is queries x all cells."""
    if not any(cells):
        return order.shape[1]
    place = np.argsort(order, axis=1)
    depth = np.sort(np.concatenate([place[i][c] for i, c in enumerate(cells) if c]))
    return int(depth[max(0, int(np.ceil(recall * len(depth))) - 1)]) + 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _share(most: int, seed: int):
    """A row's chance so that about most of n rows are taken."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 62)) < F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")) * float(1 << 62)


def _fit(cells: int | None):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["embedding"])
        c = cluster(x, min(len(x), cells or max(1, min(int(pdf["n"].iloc[0] ** 0.5), MOST_CELLS))))
        return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "cell": np.arange(len(c), dtype=np.int32), "centroid": c.tolist(), "n": pdf["n"].iloc[0], "dim": c.shape[1]})

    return fit


def _assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(centres):
        return pd.DataFrame({"project_id": [], "id": [], "cell": []})
    near = (_matrix(rows["embedding"]) @ _matrix(centres["centroid"]).T).argmax(1)
    return pd.DataFrame({"project_id": rows["project_id"], "id": rows["id"], "cell": centres["cell"].to_numpy()[near]})


def _neighbours(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Of one group of rows, the best for each held-out vector."""
    if not len(rows) or not len(held):
        return pd.DataFrame({"project_id": [], "q": [], "score": [], "cell": []})
    score = _matrix(held["embedding"]) @ _matrix(rows["embedding"]).T
    top = np.argsort(-score, axis=1, kind="stable")[:, : NEIGHBOURS + 1]
    return pd.DataFrame({"project_id": held["project_id"].iloc[0], "q": np.repeat(held["id"].to_numpy(), top.shape[1]), "score": np.take_along_axis(score, top, 1).ravel(), "cell": rows["cell"].to_numpy()[top].ravel()})


def _measure(found: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    if not len(found) or not len(centres):
        return pd.DataFrame({"project_id": [], "probes": []})
    centres = centres.sort_values("cell")
    each = found.groupby("q").agg({"cell": list, "embedding": "first"})
    order = np.argsort(-(_matrix(each["embedding"]) @ _matrix(centres["centroid"]).T), axis=1)
    return pd.DataFrame({"project_id": [centres["project_id"].iloc[0]], "probes": [probes_for(each["cell"].tolist(), order)]})


def _salted(rows: DataFrame) -> DataFrame:
    """Rows (with n and dim of their project) dealt into groups that a task can hold, whatever the project's size."""
    groups = F.ceil(F.col("n") * F.col("dim") / float(GROUP_FLOATS)).cast("int")
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), groups).cast("int"))


def _everywhere(rows: DataFrame) -> DataFrame:
    """A project's few rows (with its n and dim), once for each of its groups."""
    groups = F.ceil(F.col("n") * F.col("dim") / float(GROUP_FLOATS)).cast("int")
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1)))


_GROUP = ("project_id", "salt")


@dataclass
class VectorIndex:
    """An index of a store's vectors, below the store's folder unless a path is given."""

    store: Store
    path: str | None = None
    threshold: int | None = None

    def __post_init__(self):
        self.path = (self.path or f"{self.store.path}/vectors").rstrip("/")
        self.threshold = threshold_setting() if self.threshold is None else self.threshold
        self.spark, self.versions = self.store.spark, Versions(self.store.spark, f"{self.path}/versions")

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def meta(self) -> dict | None:
        """The description in force, if there is an index."""
        found = self.versions.read()[1]
        return found if found.get("segments") else None

    def state(self, project_id: str) -> str:
        """ready, building, absent, or below (too few vectors to be worth an index)."""
        now = self.versions.read()[1]
        if now.get("building"):
            return "building"
        if now.get("segments") and self._project(now, project_id) is not None:
            return "ready"
        return "absent" if self.store.atoms(project_id).where("embedding IS NOT NULL AND NOT invalidated").count() >= self.threshold else "below"

    def build(self, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
        """Indexes every valid record with a vector, of the projects that have enough of them."""
        number, before = self.versions.read()
        # the old index serves until the new one is ready
        number = self.versions.publish(number, before | {"building": True})
        try:
            ready = self._build(cells, sample_rows)
        except BaseException:
            self.versions.publish(number, before)
            raise
        self.versions.publish(number, ready)

    def _build(self, cells: int | None, sample_rows: int) -> dict:
        position, base = time.time_ns(), f"builds/{uuid.uuid4().hex}"
        at = lambda name: f"{self.path}/{base}/{name}"
        rows = self.store.atoms().where("embedding IS NOT NULL AND NOT invalidated AND project_id IS NOT NULL")
        sizes = rows.groupBy("project_id").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.min(F.size("embedding")).alias("least"))
        sizes.where(F.col("n") >= self.threshold).write.parquet(at("sizes"))
        sizes = self._read(f"{base}/sizes")
        if not sizes.where("dim <> least").isEmpty():
            raise ValueError("vectors of a project must be of one length")
        sizes = sizes.drop("least")
        held = _share(HELD_OUT, 1) & (F.col("n") > 2 * HELD_OUT)
        sample = rows.join(sizes, "project_id").where(_share(sample_rows, 0) & ~held)
        sample.select("project_id", "n", "embedding").groupBy("project_id").applyInPandas(_fit(cells), "project_id string, cell int, centroid array<double>, n long, dim int").write.parquet(at("centroids"))
        centres = self._read(f"{base}/centroids")
        self._segment(rows.join(sizes, "project_id"), centres, at("cells"))
        self._read(f"{base}/cells").join(sizes, "project_id").where(_share(HELD_OUT, 1)).select("project_id", "id", "embedding", "n", "dim").write.parquet(at("held"))
        asked = self._read(f"{base}/held")
        each = _salted(self._read(f"{base}/cells").select("project_id", "id", "embedding", "cell").join(sizes, "project_id")).groupBy(*_GROUP)
        best = each.cogroup(_everywhere(asked).groupBy(*_GROUP)).applyInPandas(_neighbours, "project_id string, q string, score double, cell int")
        rank = F.row_number().over(Window.partitionBy("project_id", "q").orderBy(F.col("score").desc(), "cell"))
        true = best.withColumn("rank", rank).where(F.col("rank").between(2, NEIGHBOURS + 1)).join(asked.select("project_id", F.col("id").alias("q"), "embedding"), ["project_id", "q"])
        probes = true.groupBy("project_id").cogroup(centres.groupBy("project_id")).applyInPandas(_measure, "project_id string, probes int")
        counted = centres.groupBy("project_id").agg(F.count("*").cast("int").alias("cells"))
        sizes.join(counted, "project_id").join(probes, "project_id", "left").withColumn("probes", F.coalesce("probes", "cells")).write.parquet(at("projects"))
        return {"position": position, "centroids": f"{base}/centroids", "projects": f"{base}/projects", "segments": [{"cells": f"{base}/cells", "gone": None}]}

    def _segment(self, rows: DataFrame, centres: DataFrame, path: str) -> None:
        """Writes rows (with n and dim) into their cells."""
        rows = rows.where(F.size("embedding") == F.col("dim"))
        cells = _salted(rows.select("project_id", "id", "embedding", "n", "dim")).groupBy(*_GROUP).cogroup(_everywhere(centres).groupBy(*_GROUP)).applyInPandas(_assign, "project_id string, id string, cell int")
        # a cell is one file, or several in a project of very many vectors
        files = F.ceil(F.col("n") / float(MOST_CELLS * CELL_ROWS)).cast("int")
        dealt = rows.select(*FIELDS, F.pmod(F.xxhash64("id"), files).alias("_file")).join(cells, ["project_id", "id"]).repartition("project_id", "cell", "_file")
        dealt.drop("_file").write.partitionBy("project_id", "cell").parquet(path)

    def _since(self, meta: dict, project_id: str | None = None) -> DataFrame:
        """(project_id, id) of every record touched after the index's position."""
        return self.store.events(project_id).where(F.col("seq") > meta["position"] - SLACK).select("project_id", "id").distinct()

    def update(self) -> bool:
        """Adds a segment for what the store's events have changed; False if there is no index or nothing changed."""
        number, meta = self.versions.read()
        if not meta.get("segments"):
            return False
        position, base = time.time_ns(), f"segments/{uuid.uuid4().hex}"
        sizes = self._read(meta["projects"]).select("project_id", "n", "dim")
        # written once: both tables of the segment speak of the same records
        self._since(meta).join(sizes.select("project_id"), "project_id", "left_semi").write.parquet(f"{self.path}/{base}/gone")
        gone = self._read(f"{base}/gone")
        if gone.isEmpty():
            return False
        now = fold(self.store.events().join(gone, ["project_id", "id"], "left_semi")).where("embedding IS NOT NULL AND NOT invalidated")
        self._segment(now.join(sizes, "project_id"), self._read(meta["centroids"]), f"{self.path}/{base}/cells")
        self.versions.publish(number, meta | {"position": position, "segments": [*meta["segments"], {"cells": f"{base}/cells", "gone": f"{base}/gone"}]})
        return True

    def _project(self, meta: dict, project_id: str):
        return self._read(meta["projects"]).where(F.col("project_id") == project_id).first()

    def _held(self, meta: dict, project_id: str, cells: list[int] | None) -> DataFrame:
        """A project's rows in some cells (None: all) of all segments, without copies that a later segment replaces."""
        parts, gone = [], None
        for k, s in enumerate(meta["segments"]):
            rows = self.spark.read.schema(f"{S.ATOMS}, cell int").option("basePath", f"{self.path}/{s['cells']}").parquet(f"{self.path}/{s['cells']}").where(F.col("project_id") == project_id)
            parts.append((rows if cells is None else rows.where(F.col("cell").isin(*cells))).withColumn("_segment", F.lit(k)))
            if s["gone"]:
                ids = self._read(s["gone"]).where(F.col("project_id") == project_id).select("id", F.lit(k).alias("_gone"))
                gone = ids if gone is None else gone.unionAll(ids)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if gone is not None:
            out = out.join(gone.groupBy("id").agg(F.max("_gone").alias("_gone")), "id", "left").where("_gone IS NULL OR _gone <= _segment")
        return out.select(*FIELDS)

    def nearest(self, vector: list[float], project_id: str, top_k: int = 10, probes: int | None = None, within: DataFrame | None = None) -> DataFrame | None:
        """A project's best records with score and tier, or None where it isn't indexed for such vectors.

        probes: how many cells are read, else the measured number; all of them for more
        neighbours than were measured, and for within, a bounded table of the ids (id) that
        may be found.  The driver gets the project's centroids and the ids of the result.
        """
        S.check_top_k(top_k)
        meta = self.meta()
        info = None if meta is None else self._project(meta, project_id)
        if info is None or info["dim"] != len(vector):
            return None
        few = probes if probes is not None else info["probes"] if within is None and top_k <= NEIGHBOURS else info["cells"]
        cells = None
        if few < info["cells"]:
            centres = self._read(meta["centroids"]).where(F.col("project_id") == project_id).orderBy("cell").collect()
            cells = np.argsort(-(np.array([r["centroid"] for r in centres]) @ np.array(vector)))[:few].tolist()
        touched = self._since(meta, project_id).select("id")
        held = self._held(meta, project_id, cells).join(touched, "id", "left_anti")
        new = fold(self.store.events(project_id).join(touched, "id", "left_semi")).where("NOT invalidated")
        score = dot_literal(F.col("embedding"), vector)
        brief = lambda rows: (rows if within is None else rows.join(within, "id", "left_semi")).select("id", "created_at", "row_seq", score.alias("score")).where("score IS NOT NULL")
        top = [r["id"] for r in ranked(brief(held).unionAll(brief(new)), top_k).collect()]
        # the records themselves are read for these alone
        these = F.col("id").isin(*top) if top else F.lit(False)
        reads = self.store.table("access_events", ACCESSES).where(F.col("atom_id").isin(*top) if top else F.lit(False))
        found = accessed(held.where(these).unionByName(new.where(these)), reads)
        return ranked(found.withColumns({"score": score, "tier": F.lit("R1")}), top_k)

    def drop(self) -> None:
        self.versions.delete(self.path)
