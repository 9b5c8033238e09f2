"""Planning of a search: tier, fallbacks, filters and graph expansion, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import admin, graph, retrieval
from lodestone.operators.adjacency import Adjacency
from lodestone.operators.text_index import TextIndex
from lodestone.operators.vector_index import VectorIndex
from lodestone.schema import check_top_k

TIERS = ("R0", "R1", "R2", "R3")
#: Fixed value: what a session without a topic recalls.
DEFAULT_TOPIC = "decisions patterns context architecture important"


#: a larger filtered set of candidates is scanned instead of looked up in an index
MAX_WITHIN = 10_000


def _within(rows: DataFrame, session_id: str | None, tags: list[str] | None) -> DataFrame | None | bool:
    """The candidates' ids where a filter asks for them, None without one, False if they are too many."""
    if session_id is None and tags is None:
        return None
    ids = rows.select("id")
    return ids if ids.limit(MAX_WITHIN + 1).count() <= MAX_WITHIN else False


def search(atoms: DataFrame, query: str, project_id: str, tier: str = "R3", top_k: int = 10, *, vector: list[float] | None = None, session_id: str | None = None, tags: list[str] | None = None, edges: DataFrame | Adjacency | None = None, graph_expand: bool = False, graph_depth: int = 1, strict: bool = True, strict_scope: bool = False, index: VectorIndex | None = None, text_index: TextIndex | None = None, everywhere: DataFrame | None = None, **weights: float) -> DataFrame:
    """Records with score and tier, best first.

    Without a query vector R1 and R3 fall back to R2, and rows say so.  Filters come
    before the tiers, so statistics are those of the filtered records.  Nothing is
    written: record_access is a step of its own.  With an index of the store that atoms
    come from, R1 reads the project's nearest cells and what changed since; where sessions
    or tags filter, it keeps the index's rows among the candidates, or scans these where
    they are more than MAX_WITHIN.  With a text index R2 reads postings instead of texts.
    everywhere: records of all projects, for graph neighbours, where atoms are one project's.
    """
    if project_id is None:
        raise ValueError("project_id is required")
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {', '.join(TIERS)}, got {tier!r}")
    check_top_k(top_k)
    rows = retrieval.candidates(atoms, project_id, session_id, tags)
    if tier == "R0":
        out = retrieval.exact(rows, query, top_k)
    elif tier == "R1" and vector is not None:
        found = None
        if index is not None and index.meta() is not None and (within := _within(rows, session_id, tags)) is not False:
            found = index.nearest(vector, project_id, top_k, within=within)
        out = retrieval.cosine(rows, vector, top_k) if found is None else found.select(*atoms.columns, "score", "tier")
    elif tier == "R3" and vector is not None:
        out = retrieval.fusion(rows, query, vector, top_k, strict, **weights)
    elif text_index is not None:
        out = text_index.search(rows, query, project_id, top_k, strict)
    else:
        out = retrieval.bm25(rows, query, top_k, strict)
    if graph_expand:
        if edges is None:
            raise ValueError("graph_expand needs edges")
        near = rows if strict_scope else atoms if everywhere is None else everywhere
        out = graph.expand(out, near, edges, top_k, max(1, graph_depth))
    return out


def search_in_scope(scope: str | None, atoms: DataFrame, query: str, project_id: str, top_k: int = 10, global_atoms: DataFrame | None = None, **how) -> DataFrame:
    """By scope.  Global results are filtered after their top-k, so there may be fewer."""
    if scope in (None, "project"):
        return search(atoms, query, project_id, top_k=top_k, **how)
    world = search(atoms if global_atoms is None else global_atoms, query, project_id, top_k=top_k, **how).where(F.col("scope") == "global")
    if scope == "global":
        return world
    if scope != "all":
        raise ValueError(f"unknown scope {scope!r}")
    mine = search(atoms, query, project_id, top_k=top_k, **how)
    both = mine.unionByName(world.join(mine.select("id"), "id", "left_anti").select(*mine.columns))
    return retrieval.ranked(both, top_k)


def hits(results: DataFrame) -> DataFrame:
    """What a caller of search sees."""
    return results.select(*admin.HIT)


def prime(atoms: DataFrame, project_id: str | None, topic: str | None = None, top_k: int = 8, **how) -> dict:
    """Recall at a session's start; never raises."""
    if project_id is None:
        return {"primed": False, "results": [], "note": "no project_id"}
    try:
        found = [r.asDict(True) for r in hits(search(atoms, topic or DEFAULT_TOPIC, project_id, top_k=top_k, **how)).collect()]
    except Exception:
        return {"primed": True, "results": [], "note": "recall unavailable"}
    return {"primed": True, "results": found, "note": "ok" if found else "no memory yet"}
