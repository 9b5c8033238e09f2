"""The engine's endpoints over a store.  Errors come back as {"error": ...}."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.enrichment import merged
from lodestone.operators import admin, conflicts, graph, oplog, sync
from lodestone.operators.adjacency import Adjacency
from lodestone.operators.migrations import migrate
from lodestone.operators.store import Store, new_id
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans import search as plan
from lodestone.scratch import Cuts

Enricher = Callable[[list[dict]], list[dict]]


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


class Service:
    """Endpoints bound to a project (or unbound); embed maps texts to vectors, if there is a model."""

    def __init__(self, store: Store, clock: Callable[[], str], project_id: str | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, transport: sync.Transport | None = None, blinded_project_id: str | None = None, client_id: str = "local"):
        self.store, self.clock, self.bound, self.embed = store, clock, project_id, embed
        self.transport, self.blinded, self.client = transport, blinded_project_id, client_id
        self.index, self.adjacency = VectorIndex(store), Adjacency(store)

    def call(self, name: str, **args) -> dict:
        endpoints = ("write", "search", "get", "list", "invalidate", "flush", "stats", "push", "pull", "prime", "receipts", "gc", "graph")
        if name not in endpoints:
            return {"error": f"unknown endpoint {name!r}"}
        try:
            return getattr(self, name)(**args)
        except (ValueError, TypeError) as e:
            return {"error": str(e)}
        except Exception:
            return {"error": "internal error"}

    def _project(self, project_id: str | None) -> str:
        if self.bound is not None and project_id not in (None, self.bound):
            raise ValueError("another project than the bound one")
        out = project_id or self.bound
        _require(out is not None, "project_id is required")
        return out

    def _vector(self, text: str) -> list[float] | None:
        try:
            return list(map(float, self.embed([text])[0])) if self.embed else None
        except Exception:
            return None

    def _log(self, rows: DataFrame) -> None:
        if self.blinded is not None:
            self.store.append("oplog", oplog.emit(rows, self.store.log(), self.client, self.blinded))

    def write(self, content: str, project_id: str | None = None, type: str = "diary", scope: str = "project", metadata: str | None = None, session_id: str | None = None, tags: list[str] | None = None) -> dict:
        project = self._project(project_id)
        _require(isinstance(content, str) and 0 < len(content.strip()) and len(content) <= S.MAX_CONTENT_CHARS, "content must be a text of 1 to 100000 characters")
        vector, now, key = self._vector(content), self.clock(), new_id()
        found = [] if vector is None else [r.asDict() for r in conflicts.conflicts(admin.list_project(self.store.atoms(project), project, False), vector).collect()]
        fields = "id string, content string, embedding array<float>, project_id string, type string, scope string, metadata string, session_id string, tags array<string>"
        row = self.store.spark.createDataFrame([(key, content, vector, project, type, scope, metadata or "{}", session_id, tags)], fields)
        self.store.insert(row if tags is not None else row.drop("tags"), now)
        self._log(self.store.atoms(project).where(F.col("id") == key))
        return {"id": key, "conflicts": found}

    def search(self, query: str, project_id: str | None = None, tier: str = "R3", top_k: int = 10, scope: str | None = None, record: bool = True, **how) -> dict:
        project = self._project(project_id)
        if how.get("graph_expand"):
            how |= {"edges": self.adjacency, "everywhere": None if how.get("strict_scope") else self.store.atoms()}
        found = plan.search_in_scope(scope, self.store.atoms(project), query, project, top_k, tier=tier, vector=self._vector(query), index=self.index, **how)
        rows = [r.asDict(True) for r in plan.hits(found).collect()]
        if record and rows:
            self.store.record_access(self.store.spark.createDataFrame([(r["id"],) for r in rows], "id string"), self.clock())
        return {"results": rows}

    def get(self, id: str, project_id: str | None = None) -> dict:
        project = project_id or self.bound
        row = self.store.atoms(project).where(F.col("id") == id).select(*admin.PUBLIC).first()
        if row is None or (project is not None and row.project_id != project):
            return {"found": False}
        return {"found": True, "record": row.asDict(True)}

    def list(self, project_id: str | None = None, scope: str | None = None, include_invalidated: bool = False, limit: int | None = None) -> dict:
        rows = admin.in_scope(scope, self.store.atoms(self._project(project_id)), self._project(project_id), None, include_invalidated, limit)
        return {"records": [r.asDict(True) for r in rows.select(*admin.PUBLIC).collect()]}

    def invalidate(self, id: str, project_id: str | None = None) -> dict:
        found = self.get(id, project_id)
        if not found["found"]:
            return {"found": False}
        project = found["record"]["project_id"]
        self.store.mark(self.store.spark.createDataFrame([(id,)], "id string"), "invalidate", self.clock(), project)
        self._log(self.store.atoms(project).where(F.col("id") == id))
        return {"found": True, "invalidated": True}

    def flush(self, project_id: str | None = None, enrich: Enricher | None = None) -> dict:
        """Enriches records that aren't; enrich maps {id, content, metadata} to {id, answer} or {id, metadata}.

        An answer is a model's text, merged field by field; one that is no JSON object
        leaves its record as it is.  metadata is JSON text that replaces the record's.
        """
        if enrich is None:
            return {"enriched": 0, "skipped": True, "reason": "no enricher"}
        rows = admin.unenriched(self.store.atoms(self._project(project_id))).select("id", "content", "metadata")
        done = 0
        for part in _batches(rows):
            own, now = {r["id"]: r["metadata"] for r in part}, self.clock()
            found = enrich(part)
            out = [(r["id"], r["metadata"]) for r in found if "metadata" in r]
            answers = [(r["id"], own[r["id"]], r["answer"]) for r in found if "metadata" not in r]
            if answers:
                read = self.store.spark.createDataFrame(answers, "id string, metadata string, answer string")
                out += [tuple(r) for r in read.select("id", merged(F.col("metadata"), F.col("answer"), now)).collect() if r[1] is not None]
            if out:
                self.store.mark(self.store.spark.createDataFrame(out, "id string, metadata string"), "enrich", now)
            done += len(out)
        self._try_sync("push")
        return {"enriched": done, "skipped": False, "reason": None}

    def stats(self, project_id: str | None = None) -> dict:
        out = admin.stats(self.store.atoms(self._project(project_id))).first().asDict()
        last = self.store.cursors().agg(F.max("updated_at")).first()[0]
        return {**out, "last_sync": last}

    def start(self) -> None:
        """At the start of a session: the store's steps that are due, and a pull, if there is a relay; its failure is no error."""
        migrate(self.store)
        self._try_sync("pull")

    def _try_sync(self, direction: str) -> None:
        if self.transport is not None and self.blinded is not None:
            with contextlib.suppress(Exception):
                self._sync(direction)

    def _sync(self, direction: str) -> dict:
        return sync.sync_now(self.store, self.transport, self.blinded, self.client, self.clock(), (direction,)).__dict__

    def push(self) -> dict:
        return self._sync("push")

    def pull(self) -> dict:
        return self._sync("pull")

    def prime(self, project_id: str | None = None, topic: str | None = None, top_k: int = 8) -> dict:
        if topic is not None:
            _require(isinstance(topic, str) and len(topic) <= S.MAX_TOPIC_CHARS, "topic must be a text of at most 1000 characters")
        project = project_id or self.bound
        return plan.prime(self.store.atoms(project), project, topic, top_k, index=self.index, vector=self._vector(topic or plan.DEFAULT_TOPIC))

    def receipts(self, project_id: str | None = None, op: str | None = None, limit: int = 100, form: str = "json") -> dict:
        _require(op in (None, "write", "invalidate"), "op must be write or invalidate")
        _require(form in ("json", "text"), "form must be json or text")
        if self.blinded is None:
            return {"receipts": []}
        rows = oplog.receipts(self.store.log(), self.blinded, self._project(project_id), op, limit).collect()
        return {"text": "\n".join(r.line for r in rows)} if form == "text" else {"receipts": [r.asDict() for r in rows]}

    def gc(self, project_id: str | None = None, min_age_days: int = 90, max_access: int = 1, apply: bool = False) -> dict:
        _require(not isinstance(min_age_days, bool) and isinstance(min_age_days, int) and min_age_days >= 0, "min_age_days must be a whole number from 0")
        rows = admin.gc_report(self.store.atoms(self._project(project_id)), self.clock(), min_age_days, max_access)
        # written once, marked as a table; the caller sees the first of them and how many there are
        found = Cuts(self.store.spark).cut(rows)
        n = found.count()
        if apply and n:
            self.store.mark(found.select("id"), "invalidate", self.clock(), self._project(project_id))
            self._log(self.store.atoms(self._project(project_id)).join(found.select("id"), "id", "left_semi"))
        return {"stale": [r.asDict() for r in found.orderBy("access_count", "created_at", "id").limit(S.MAX_TOP_K).collect()], "total": n, "invalidated": n if apply else 0}

    def graph(self, entity: str, project_id: str | None = None, max_depth: int = 2, edge_types: list[str] | None = None, top_k: int = 3) -> dict:
        """The subgraph around a record, or around what a search for the entity finds."""
        project, everywhere = self._project(project_id), self.store.atoms()
        atoms = self.store.atoms(project)
        _require(edge_types is None or set(edge_types) <= set(S.EDGE_TYPES), "unknown edge type")
        roots = atoms.where((F.col("id") == entity) & (F.col("project_id") == project)).select(F.col("id").alias("root"))
        if roots.first() is None:
            roots = plan.search(atoms, entity, project, top_k=top_k, vector=self._vector(entity), index=self.index).select(F.col("id").alias("root"))
        nodes, edges = graph.traverse(self.adjacency, everywhere, roots, max_depth, edge_types)
        return {"nodes": [r.asDict(True) for r in nodes.select(*admin.PUBLIC).collect()], "edges": [r.asDict() for r in edges.collect()]}


def _batches(rows: DataFrame, size: int = 100):
    part: list[dict] = []
    for r in rows.toLocalIterator():
        part.append(r.asDict())
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
