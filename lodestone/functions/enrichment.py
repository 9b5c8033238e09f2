"""What a language model answers about a record, merged into its metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SUMMARY_CHARS = 1000
FENCE = "```"


def unfenced(c: Column) -> Column:
    """Trimmed; of a text that opens with a fence and has three lines or more, those between the first and the last."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(text.startswith(FENCE), F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1), F.lit("")), text)).otherwise(text)


def merged(metadata: Column, answer: Column, now: str) -> Column:
    """Metadata (JSON text) with the answer's summary, entities and keywords; null for an answer that is no JSON object.

    A field of another kind than text (summary, cut at 1000 characters) or list of texts
    is left out, and the record keeps its own.  Lists are stored as JSON text.
    """
    v = F.try_parse_json(unfenced(answer))
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    summary = F.when(kind("$.summary") == "STRING", F.substring(F.try_variant_get(v, "$.summary", "string"), 1, MAX_SUMMARY_CHARS))

    def listed(path: str) -> Column:
        found = F.try_variant_get(v, path, "array<string>")
        return F.when(kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(found, lambda x: x.isNull()), F.to_json(found))

    own = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = {"summary": summary, "entities": listed("$.entities"), "keywords": listed("$.keywords"), "enriched": F.lit("true"), "enriched_at": F.lit(now)}
    new = F.map_filter(F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), c)]), lambda _, x: x.isNotNull())
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(F.map_concat(kept, new)))
