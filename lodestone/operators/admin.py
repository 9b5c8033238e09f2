"""Listing, statistics, staleness, mirror files and capture validation."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import category, mirror_line
from lodestone.schema import MAX_LINE_BYTES, valid_timestamp

PUBLIC = ("id", "content", "project_id", "type", "scope", "metadata", "refs", "invalidated", "created_at", "updated_at", "session_id", "tags")
HIT = ("id", "content", "score", "tier", "type", "scope", "invalidated", "metadata")


def list_project(atoms: DataFrame, project_id: str, include_invalidated: bool = True, limit: int | None = None) -> DataFrame:
    """A project's records, newest first."""
    out = atoms.where(F.col("project_id") == project_id)
    out = out if include_invalidated else out.where(~F.col("invalidated"))
    out = out.orderBy(F.col("created_at").desc(), F.col("row_seq").desc())
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        out = out.limit(limit)
    return out


def in_scope(scope: str | None, atoms: DataFrame, project_id: str, global_atoms: DataFrame | None = None, include_invalidated: bool = False, limit: int | None = None) -> DataFrame:
    """Records by scope; for all, the project's and the global ones without those the project has too."""
    if scope not in (None, "project", "global", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    keep = F.lit(True) if include_invalidated else ~F.col("invalidated")
    mine = atoms.where((F.col("project_id") == project_id) & keep)
    world = (atoms if global_atoms is None else global_atoms).where((F.col("project_id") == project_id) & (F.col("scope") == "global") & keep)
    out = mine if scope in (None, "project") else world if scope == "global" else mine.unionByName(world.join(mine.select("id"), "id", "left_anti"))
    out = out.orderBy(F.col("created_at").desc(), F.col("row_seq").desc())
    return out if limit is None else out.limit(limit)


def stats(atoms: DataFrame) -> DataFrame:
    flushed = F.when(F.schema_of_variant(F.variant_get(F.try_parse_json("metadata"), "$.enriched_at", "variant")) == "STRING", F.get_json_object("metadata", "$.enriched_at"))
    return atoms.agg(F.count("*").alias("total"), F.count_if("invalidated").alias("invalidated"), F.count_if(~F.col("invalidated")).alias("active"), F.max(flushed).alias("last_flush"))


def stale(atoms: DataFrame, now: str, min_age_days: int, max_access: int) -> DataFrame:
    """Valid records of that age that were read less often than max_access; least read, then oldest, first.

    Times compare as text, as they are stored.
    """
    cutoff = F.date_format(F.to_timestamp_ntz(F.lit(now)) - F.make_interval(days=F.lit(min_age_days)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return atoms.where(~F.col("invalidated") & (F.col("created_at") <= cutoff) & (F.col("access_count") < max_access)).orderBy("access_count", "created_at", "row_seq")


def gc_report(atoms: DataFrame, now: str, min_age_days: int, max_access: int) -> DataFrame:
    return stale(atoms, now, min_age_days, max_access).select("id", F.substring("content", 1, 160).alias("content"), "access_count", "last_accessed", "created_at")


def unenriched(atoms: DataFrame) -> DataFrame:
    """Valid records whose metadata don't say that they are enriched."""
    flag = F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$.enriched", "boolean"), F.lit(False))
    return atoms.where(~F.col("invalidated") & ~flag)


def mirror_rows(atoms: DataFrame, project_id: str) -> DataFrame:
    """(category, created_at, id, line) of a project's valid records."""
    rows = atoms.where((F.col("project_id") == project_id) & ~F.col("invalidated"))
    cat = category(F.coalesce(F.nullif(F.get_json_object("metadata", "$.category"), F.lit("")), F.lit("notes")))
    return rows.select(cat.alias("category"), "created_at", "id", mirror_line(F.col("content")).alias("line"))


def mirror_counts(atoms: DataFrame, project_id: str) -> DataFrame:
    return mirror_rows(atoms, project_id).groupBy("category").agg(F.count("*").alias("n"))


def write_mirror(atoms: DataFrame, project_id: str, folder: str, name: str = "lodestone") -> dict[str, int]:
    """Writes <folder>/<category>.md; what stands outside a file's managed block stays.

    Rows come to the driver one partition at a time, in order, since files are written there.
    """
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    counts: dict[str, int] = {}
    Path(folder).mkdir(parents=True, exist_ok=True)

    def flush(cat: str, lines: list[str]) -> None:
        path, inner = Path(folder, f"{cat}.md"), "".join(x + "\n" for x in lines)
        old = path.read_text(encoding="utf-8") if path.exists() else None
        a, b = (old.find(start), old.find(end)) if old is not None else (-1, -1)
        if a != -1 and b > a:
            text = old[: a + len(start)] + "\n" + inner + old[b:]
        else:
            text = (old if not old or old.endswith("\n") else old + "\n") if old else ""
            text += f"{start}\n{inner}{end}\n"
        path.write_text(text, encoding="utf-8")
        counts[cat] = len(lines)

    current, lines = None, []
    for r in mirror_rows(atoms, project_id).orderBy("category", "created_at", "id").toLocalIterator():
        if r.category != current and current is not None:
            flush(current, lines)
            lines = []
        current = r.category
        lines.append(r.line)
    if current is not None:
        flush(current, lines)
    return counts


#: texts that look like credentials (our own list)
CREDENTIALS = (r"sk-[A-Za-z0-9_-]{20,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"xox[abpr]-[A-Za-z0-9-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"(?i:api[_-]?key|secret|passwd|password|token)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{16,}")


def looks_secret(c: Column) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in CREDENTIALS))


def captured(lines: DataFrame, project_id: str | None = None, drained_at: str | None = None) -> DataFrame:
    """Raw lines (value) with status and the record's fields; blank lines drop out.

    Status, the first that fits: malformed (too long, no JSON object, no content, no
    project, an unknown type), foreign (another project than the bound one), secret,
    written.  created_at is the line's own time if it is valid, else drained_at.
    """
    from lodestone.schema import TYPES

    line = lines.select(F.trim(F.regexp_replace("value", r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$", "")).alias("line")).where("length(line) > 0")
    v = F.try_parse_json("line")
    kind = lambda p: F.schema_of_variant(F.variant_get(F.col("_v"), p, "variant"))
    text = lambda p: F.when(kind(p) == "STRING", F.variant_get(F.col("_v"), p, "string"))
    wide = line.withColumn("_v", F.when(F.octet_length("line") <= MAX_LINE_BYTES, v))
    wide = wide.withColumns({"content": text("$.content"), "project_id": text("$.project_id"), "type": F.coalesce(F.nullif(text("$.type"), F.lit("")), F.lit("diary")), "session_id": text("$.session_id"), "ts": text("$.ts"), "metadata": F.when(kind("$.metadata").startswith("OBJECT"), F.to_json(F.variant_get(F.col("_v"), "$.metadata", "variant")))})
    bad = F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT") | F.col("content").isNull() | (F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == "") | F.col("project_id").isNull() | (F.col("project_id") == "") | ~F.col("type").isin(*TYPES)
    status = F.when(F.coalesce(bad, F.lit(True)), "malformed")
    if project_id is not None:
        status = status.when(F.col("project_id") != project_id, "foreign")
    status = status.when(looks_secret(F.col("content")), "secret").otherwise("written")
    now = F.lit(drained_at) if drained_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return wide.select(status.alias("status"), "content", "project_id", "type", "session_id", "metadata", F.when(valid_timestamp(F.col("ts")), F.col("ts")).otherwise(now).alias("created_at"), F.sha2("line", 256).alias("line_hash"))


def drain_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
