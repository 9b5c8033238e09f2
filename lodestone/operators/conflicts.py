"""Near-equal records by cosine similarity of their vectors."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import snippet
from lodestone.functions.vectors import dot_literal
from lodestone.operators.vector_index import MOST_CELLS, cluster
from lodestone.scratch import Cuts

THRESHOLD = 0.92
#: numbers (of a vector, or angles of a row) that the rows of one task have, and angles held at a time
TASK_NUMBERS, ANGLES_AT_ONCE = 32_000_000, 4_000_000
#: an angle for rounding
SLACK = 1e-5
CELL = ("project_id", "dim", "cell")


def resolve_threshold(name: str = "LODESTONE_SIMILARITY") -> float:
    """From the environment if it holds a number in (0, 1], else the default."""
    try:
        value = float(os.environ.get(name, ""))
    except ValueError:
        return THRESHOLD
    return value if 0 < value <= 1 else THRESHOLD


def conflicts(atoms: DataFrame, vector: list[float], threshold: float | None = None, exclude_id: str | None = None) -> DataFrame:
    """(id, similarity, snippet) of records at or above the threshold; the threshold holds before rounding."""
    least = resolve_threshold() if threshold is None else threshold
    rows = atoms if exclude_id is None else atoms.where(F.col("id") != exclude_id)
    return rows.withColumn("_s", dot_literal(F.col("embedding"), vector)).where(F.col("_s") >= least).select("id", F.bround("_s", 4).alias("similarity"), snippet(F.col("content")).alias("snippet"))


def superseded(atoms: DataFrame, vector: list[float], threshold: float | None = None, exclude_id: str | None = None) -> DataFrame:
    return conflicts(atoms, vector, threshold, exclude_id).select("id")


def invalidate_superseded(store, vector: list[float], project_id: str, now: str, threshold: float | None = None, exclude_id: str | None = None) -> DataFrame:
    """Marks a project's valid records at or above the threshold as invalid; their ids.

    The ids are written first, so that the marks and what the caller reads are one set.
    """
    mine = store.atoms(project_id).where(~F.col("invalidated"))
    found = Cuts(store.spark).cut(superseded(mine, vector, threshold, exclude_id))
    store.mark(found, "invalidate", now, project_id)
    return found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), len(column.iloc[0]) if len(column) else 0)


def _units(column: pd.Series) -> np.ndarray:
    x = _matrix(column)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, centres: np.ndarray):
    """(slice, angles to all centres) of a few rows at a time."""
    step = max(1, ANGLES_AT_ONCE // max(1, len(centres)))
    for k in range(0, len(x), step):
        yield slice(k, k + step), np.arccos(np.clip(x[k : k + step] @ centres.T, -1.0, 1.0))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _units(pdf["embedding"])
    c = cluster(x, min(len(x), int(pdf["cells"].iloc[0])))
    return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "dim": pdf["dim"].iloc[0], "cell": np.arange(len(c), dtype=np.int32), "centre": c.tolist()})


def _homes(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Each row's nearest centre and its angle to it."""
    cell, angle = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    if len(rows):
        centres = centres.sort_values("cell")
        for at, a in _angles(_units(rows["embedding"]), _units(centres["centre"])):
            best = a.argmin(1)
            cell[at], angle[at] = centres["cell"].to_numpy()[best], a[np.arange(len(a)), best]
    return rows[["project_id", "dim", "id", "embedding", "reach", "n", "cells", "salt"]].assign(cell=cell, angle=angle)


def _visits(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """The cells after its own in which a row can have a partner, by the triangle inequality."""
    found: list[np.ndarray] = []
    if len(rows):
        cells, radius = centres["cell"].to_numpy(), centres["radius"].to_numpy()
        home, own, reach = (rows[c].to_numpy()[:, None] for c in ("cell", "angle", "reach"))
        for at, a in _angles(_units(rows["embedding"]), _units(centres["centre"])):
            near = (a <= reach[at] + radius + SLACK) & (a <= own[at] + 2 * reach[at] + SLACK) & (cells > home[at])
            found += [cells[row] for row in near]
    return rows[["project_id", "dim", "id", "embedding"]].assign(visits=found)


def meetings(atoms: DataFrame, threshold: float, block_rows: int = 2000, sample_rows: int = 20_000) -> DataFrame:
    """(project_id, dim, cell, id, embedding, home): where the rows of a project must meet to find its pairs.

    Cells around centres, fitted on a bounded sample of at most about sample_rows rows of
    a project, partition its vectors; a row is at home in the cell of its nearest centre.
    Partners lie within an angle, the row's reach: arccos(threshold / (its length times
    the greatest length)).  So a row visits another cell only if its angle to that centre
    is within reach plus the cell's radius, and within twice its reach plus its angle to
    its own centre.  Of two cells only the rows of the earlier one visit.  Every pair at or
    above the threshold meets in the cell of one of the two; whatever the centres are,
    nothing is lost.  A threshold of 0 or less rules nothing out, and vectors without any
    clusters meet in most cells.  Up to block_rows rows of a project are one cell.
    """
    cuts = Cuts(atoms.sparkSession)
    length = F.sqrt(F.aggregate(F.transform("embedding", lambda v: v.cast("double")), F.lit(0.0), lambda t, v: t + v * v))
    rows = atoms.where(F.col("embedding").isNotNull() & ~F.col("invalidated") & F.col("project_id").isNotNull()).select("project_id", "id", "embedding", F.size("embedding").alias("dim"), length.alias("length"))
    rows = cuts.cut(rows.where(F.col("length") < float("inf")))
    sizes = rows.groupBy("project_id", "dim").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    sizes = sizes.withColumn("cells", F.when(F.col("n") <= block_rows, 1).otherwise(F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt("n")))).cast("int"))
    share = F.col("length") * F.col("longest")
    reach = F.lit(np.pi) if threshold <= 0 else F.acos(F.least(F.lit(1.0), F.lit(threshold) / share))
    groups = F.ceil(F.col("n") * F.greatest("dim", "cells") / float(TASK_NUMBERS)).cast("int")
    sized = rows.join(sizes, ["project_id", "dim"])
    # rows too short to reach the threshold with any other have no partner
    able = sized if threshold <= 0 else sized.where(share >= threshold * (1 - 1e-9))
    dealt = able.select("project_id", "dim", "id", "embedding", reach.alias("reach"), "n", "cells", F.pmod(F.xxhash64("id"), groups).cast("int").alias("salt"))

    taken = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 62)) < F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n")) * float(1 << 62)
    sample = sized.where(taken).select("project_id", "dim", "cells", "embedding")
    centres = cuts.cut(sample.groupBy("project_id", "dim").applyInPandas(_fit, "project_id string, dim int, cell int, centre array<double>"))
    everywhere = centres.join(sizes, ["project_id", "dim"]).withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1)))
    group = ("project_id", "dim", "salt")
    homes = dealt.groupBy(*group).cogroup(everywhere.select(*group, "cell", "centre").groupBy(*group))
    homes = cuts.cut(homes.applyInPandas(_homes, "project_id string, dim int, id string, embedding array<float>, reach double, n long, cells int, salt int, cell int, angle double"))
    radii = homes.groupBy("project_id", "dim", "cell").agg(F.max("angle").alias("radius"))
    bounded = everywhere.join(radii, ["project_id", "dim", "cell"]).select(*group, "cell", "centre", "radius")
    guests = homes.groupBy(*group).cogroup(bounded.groupBy(*group)).applyInPandas(_visits, "project_id string, dim int, id string, embedding array<float>, visits array<int>")
    columns = (*CELL, "id", "embedding")
    guests = guests.withColumn("cell", F.explode("visits")).select(*columns, F.lit(False).alias("home"))
    return cuts.cut(homes.select(*columns, F.lit(True).alias("home")).unionAll(guests))


def blocks(met: DataFrame, task_rows: int) -> DataFrame:
    """(project_id, dim, cell, id, embedding, blk, bi, bj): the rows of meetings, once for each pair of blocks (bi, bj) to compare."""
    number = lambda which: F.ceil(F.count_if(which) / task_rows).cast("int")
    counts = met.groupBy(*CELL).agg(number(F.col("home")).alias("own"), number(~F.col("home")).alias("guests"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # a cell's own blocks come first; they meet each other and the guests' blocks
    dealt = met.join(counts, list(CELL)).withColumn("blk", F.when(F.col("home"), spread(F.col("own"))).otherwise(F.col("own") + spread(F.col("guests"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("own") + F.col("guests")).otherwise(F.col("own")) - 1)))
    return dealt.select(*CELL, "id", "embedding", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))


def all_pairs(atoms: DataFrame, threshold: float | None = None, block_rows: int = 2000, task_rows: int = 2000) -> DataFrame:
    """(project_id, id_a, id_b, similarity), id_a < id_b, of valid records with vectors, within a project.

    Exact.  Vectors are compared only in the cells where they meet (meetings, whose cells
    begin above block_rows rows).  A cell is dealt into blocks of about task_rows rows and
    each pair of blocks is one matrix product, so a cell that holds most of a project is
    many tasks and no task holds more than two blocks, however small cells may be; only
    pairs at or above the threshold come out.  Records without a
    project, and vectors with numbers that are null or not finite, are left out; an empty
    table gives no pairs, and vectors of different lengths are never compared.
    """
    least = resolve_threshold() if threshold is None else threshold
    dealt = blocks(meetings(atoms, least, block_rows), task_rows)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["embedding"])
        ids, blk, bi, bj = pdf["id"].to_numpy(), pdf["blk"].to_numpy(), pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        sims = x[left] @ x[right].T
        i, j = np.nonzero(sims >= least)
        a, b, s = ids[left[i]], ids[right[j]], sims[i, j]
        keep = (a < b) if bi == bj else (a != b)
        a, b, s = a[keep], b[keep], s[keep]
        return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "similarity": s})

    return dealt.groupBy(*CELL, "bi", "bj").applyInPandas(compare, "project_id string, id_a string, id_b string, similarity double")
