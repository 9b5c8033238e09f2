"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: losing an executor loses none of it, and every reader
sees the same rows, whatever a plan above would make of a second run.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_open: list[list[Cuts]] = []
_left: list[Cuts] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


class Cuts:
    """Tables written by one run of an operator.

    A result that is read later still needs them, so they are deleted by whoever
    knows that it has been read: drop for one table, released() for all that an
    operator has made; what is left goes at the end of the process.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}", []
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        (_open[-1] if _open else _left).append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.made)}"
        self.made.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.conf).delete(where, True)

    def drop(self, which: int) -> None:
        """Deletes the table of that number; only once nothing reads it any more."""
        self._delete(self.made[which])

    def drop_all(self) -> None:
        self._delete(self.base)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the tables of all operators started within; their results must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for cuts in _open.pop():
            cuts.drop_all()


@atexit.register
def _drop_left() -> None:
    for cuts in _left:
        with contextlib.suppress(Exception):  # the session may be gone
            cuts.drop_all()
