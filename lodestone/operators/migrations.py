"""Numbered steps that bring a store's files to the present layout.

Steps are taken in order, each at most once by record: the number of the last one is a
version of its own (versions.Versions), written when the step is done.  A step may be
taken again after it broke off, at whatever point, and then ends as if it never had.
What old files lack and needs no rewriting is given by readers (schema.DEFAULTS).  Run
while nobody else writes; a store of a later layout is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from lodestone.operators.store import EVENTS, Store
from lodestone.versions import Conflict, Versions


@dataclass(frozen=True)
class Step:
    number: int
    what: str
    run: Callable[[Store], None] | None = None


def _files_above_projects(store: Store) -> list[str]:
    return [f for f in Versions(store.spark, store.path).files(f"{store.path}/atom_events") if "/" not in f and f.endswith(".parquet")]


def _into_project_folders(store: Store) -> None:
    """Events that stand in one folder go to their projects'; they count as written before all that have a number.

    The old files are deleted last.  If that broke off, events stand twice, which changes
    no record, until a compaction.
    """
    old = _files_above_projects(store)
    if not old:
        return
    rows = store.spark.read.schema(EVENTS).parquet(*[f"{store.path}/atom_events/{f}" for f in old])
    store.append("atom_events", rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("seq", "row_seq")}), "project_id")
    versions = Versions(store.spark, store.path)
    for f in old:
        versions.delete(f"{store.path}/atom_events/{f}")


STEPS = (
    Step(1, "records, links and logs as tables of events"),
    Step(2, "sessions, tags and accesses; readers give what older files lack"),
    Step(3, "events in a folder for each project, numbered by their writing", _into_project_folders),
)


def _record(store: Store) -> Versions:
    return Versions(store.spark, f"{store.path}/layout")


def layout(store: Store) -> int:
    """The number of the last step taken; 0 before the first."""
    return _record(store).read()[1].get("step", 0)


def migrate(store: Store, steps: tuple[Step, ...] = STEPS) -> list[int]:
    """Takes the steps that the store hasn't had, and gives their numbers."""
    if [s.number for s in steps] != sorted({s.number for s in steps}):
        raise ValueError("steps must be in the order of their numbers")
    record, taken = _record(store), []
    for step in steps:
        number, state = record.read()
        now = state.get("step", 0)
        if now > steps[-1].number:
            raise ValueError(f"the store has layout {now}, this program knows {steps[-1].number}")
        if step.number <= now:
            continue
        if step.run is not None:
            step.run(store)
        try:
            record.publish(number, {"step": step.number, "what": step.what})
        except Conflict:
            if layout(store) < step.number:
                raise
        taken.append(step.number)
    return taken
