"""Numbered descriptions of a table's state, so that a change of it is one rename.

A description is written beside the others under a name of its own and renamed to the
next number; the greatest number is the state.  Whoever has read a description may go
on reading what it names, until that is deleted.  Two writers of one number: the
second fails and leaves the table as the first made it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    pass


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        fs, p = self._at(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """(number, description), the latest unless a number is given; (0, {}) where there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        fs, p = self._at(f"{self.path}/{number:012d}.json")
        stream = fs.open(p)
        try:
            return number, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, after: int, description: dict) -> int:
        """Makes a description the state that follows number after."""
        fs, temporary = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        _, final = self._at(f"{self.path}/{after + 1:012d}.json")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(description).encode()))
        out.close()
        # a rename onto a name that is there fails on a distributed file system; a local one would replace it
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"version {after + 1} was written by another")
        return after + 1

    def files(self, folder: str) -> list[str]:
        """Names of the data files below a folder, relative to it; those of a write under way don't count."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        base, found, each = fs.makeQualified(p).toString().rstrip("/") + "/", [], fs.listFiles(p, True)
        while each.hasNext():
            name = each.next().getPath().toString().removeprefix(base)
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found.append(name)
        return sorted(found)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
