"""Table schemas, enumerations and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOMS = (
    "id string, content string, embedding array<float>, project_id string, type string, scope string, metadata string, refs array<string>, "
    "invalidated boolean, created_at string, updated_at string, session_id string, access_count bigint, last_accessed string, tags array<string>, row_seq bigint"
)
EDGES = "id bigint, from_atom_id string, to_atom_id string, edge_type string, project_id string, metadata string, created_at string"
TRIPLES = "id bigint, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_ref string, project_id string, created_at string"
OPLOG = "entry_id string, client_id string, sequence_no bigint, op string, record_id string, blinded_project_id string, ts string, payload binary, source string, pushed boolean"
CURSORS = "blinded_project_id string, direction string, peer_id string, last_seq bigint, last_cursor string, updated_at string"
RELAY = "ingest_seq bigint, entry_id string, client_id string, sequence_no bigint, op string, record_id string, blinded_project_id string, ts string, payload binary"
AUDIT = "ts string, token_hash string, blinded_project_id string, op string, entry_count bigint, byte_count bigint, status string"

#: what a column is where a file was written without it, or holds null
DEFAULTS = {
    "records": {"type": "'diary'", "scope": "'project'", "metadata": "'{}'", "refs": "cast(array() as array<string>)"},
    "oplog": {"source": "'local'", "pushed": "false"},
    "kg_triples": {"confidence": "1.0D"},
}

#: The enumerations of the data model.
TYPES = ("decision", "pattern", "diary", "entity", "oq-resolution", "infra-fact", "server", "deploy-target")
SCOPES = ("project", "global", "all")
EDGE_TYPES = ("supersedes", "blocks", "touches_file", "decided_by", "depends_on", "causal")
OPS = ("upsert", "invalidate")
DIRECTIONS = ("push", "pull")

#: The limits of the data model.
MAX_CONTENT_CHARS, MAX_TOP_K, MAX_TOPIC_CHARS = 100_000, 1000, 1000
MAX_LINE_BYTES, MAX_PAYLOAD_BYTES, MAX_BATCH_ENTRIES, PAGE_ENTRIES = 1 << 20, 1 << 20, 1000, 500

ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.expr(e)) for c, e in DEFAULTS[table].items()})


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def valid_timestamp(c: Column) -> Column:
    """True for an ISO-8601 UTC text that names a day and time of the calendar; false, never null, otherwise."""
    return F.coalesce(c.rlike(ISO_UTC) & F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


def valid_cursor(c: Column) -> Column:
    """Null, empty, or up to 19 digits."""
    return c.isNull() | (c == "") | c.rlike("^[0-9]{1,19}$")


def check_cursor(cursor: str | None) -> int:
    """The number of a cursor; null and empty are 0."""
    text = cursor or "0"
    if not (isinstance(text, str) and text.isascii() and text.isdigit() and len(text) <= 19):
        raise ValueError(f"a cursor is up to 19 digits, got {cursor!r}")
    return int(text)


def valid_blinded_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def checked(df: DataFrame, **rules: Column) -> DataFrame:
    """Fails the query on a row that breaks a rule (name: condition)."""
    for name, rule in rules.items():
        df = df.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"broken rule: {name}")).cast("boolean")))
    return df


def check_top_k(top_k: int) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be a whole number from 1 to {MAX_TOP_K}, got {top_k!r}")
    return top_k
