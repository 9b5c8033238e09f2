"""Ranking tiers over candidate records: exact, cosine, BM25 and their fusion.

Candidates are a DataFrame of records (schema.ATOMS).  Every tier is one lazy plan
ending in a top-k; statistics a tier needs (corpus size, lengths, document
frequencies, score ranges) are single-row aggregates joined as broadcasts of one
row.  Ties: score, then newest, then the later row, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fts
from lodestone.functions.text import tokens as token_array
from lodestone.functions.vectors import dot_literal
from lodestone.schema import check_top_k

K1, B = 1.2, 0.75
W_COS, W_BM25, W_ACCESS = 0.55, 0.35, 0.1


def ranked(df: DataFrame, top_k: int | None) -> DataFrame:
    """Best first; a top-k is taken per partition before it is merged."""
    out = df.orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("row_seq").desc(), F.col("id"))
    return out if top_k is None else out.limit(check_top_k(top_k))


def candidates(atoms: DataFrame, project_id: str, session_id: str | None = None, tags: list[str] | None = None, include_invalidated: bool = False) -> DataFrame:
    """A project's valid records, by session and by overlapping tags (no case; records without tags never match)."""
    out = atoms.where(F.col("project_id") == project_id)
    if not include_invalidated:
        out = out.where(~F.col("invalidated"))
    if session_id is not None:
        out = out.where(F.col("session_id") == session_id)
    if tags is not None:
        wanted = F.array(*[F.lit(t.lower()) for t in tags]).cast("array<string>")
        out = out.where(F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), wanted), F.lit(False)))
    return out


def exact(atoms: DataFrame, query: str, top_k: int | None = 10) -> DataFrame:
    return ranked(atoms.where(F.col("content") == query).withColumns({"score": F.lit(1.0), "tier": F.lit("R0")}), top_k)


def cosine(atoms: DataFrame, query: list[float], top_k: int | None = 10) -> DataFrame:
    """By dot product of unit vectors; records without a vector of that length are left out."""
    scored = atoms.withColumn("score", dot_literal(F.col("embedding"), query)).where(F.col("score").isNotNull())
    return ranked(scored.withColumn("tier", F.lit("R1")), top_k)


def bm25_scores(atoms: DataFrame, query: str, strict: bool = True) -> DataFrame:
    """Matching records with score; corpus statistics are those of the given records.

    The sum runs over the query's phrases that are in the record, save those below a
    part of the query that the record doesn't match; a phrase in more than half of
    the records weighs 1e-6.
    """
    node = fts.parse(query, strict)
    if node is None:
        return atoms.withColumn("score", F.lit(0.0)).where(F.lit(False))
    found = fts.leaves(node)
    # a NEAR member's weight comes from the rows that hold the member at all
    rows = {i: f"_has{i}" for i, (_, near) in enumerate(found) if near is not None}

    def counts(t: Column) -> Column:
        return F.struct(F.size(t).alias("_length"), *[fts.frequency(t, p, near).alias(f"_tf{i}") for i, (p, near) in enumerate(found)], *[(fts.occurrences(t, found[i][0]) > 0).alias(name) for i, name in rows.items()])

    # the lambda's argument is the token array, made once for a row
    counted = F.get(F.transform(F.array(token_array(F.col("content"))), counts), F.lit(0))
    return scored(atoms.withColumn("_c", counted).select(*atoms.columns, "_c.*"), atoms.columns, node)


def scored(wide: DataFrame, columns: list[str], node: fts.Node, totals: DataFrame | None = None) -> DataFrame:
    """columns and score of the rows that match, from _length, and _tf<i> (for a NEAR member also _has<i>) for each leaf.

    totals: one row (_n, _mean), where wide holds only rows with some leaf.
    """
    found = fts.leaves(node)
    present = {i: F.col(f"_tf{i}") > 0 for i in range(len(found))}
    has = {i: present[i] if near is None else F.col(f"_has{i}") for i, (_, near) in enumerate(found)}
    frequencies = [F.count_if(has[i]).alias(f"_df{i}") for i in has]
    if totals is None:
        stats = wide.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *frequencies)
    else:
        stats = wide.agg(*frequencies).crossJoin(F.broadcast(totals))

    def part(i: int) -> Column:
        n, df, tf = F.col("_n"), F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.ln((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))

    matches, counting = fts.match(node, present)
    matched = wide.where(matches).crossJoin(F.broadcast(stats))
    return matched.withColumn("score", reduce(lambda a, b: a + b, [F.when(counting[i], part(i)).otherwise(0.0) for i in present])).select(*columns, "score")


def bm25(atoms: DataFrame, query: str, top_k: int | None = 10, strict: bool = True) -> DataFrame:
    return ranked(bm25_scores(atoms, query, strict).withColumn("tier", F.lit("R2")), top_k)


def min_max(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Each column scaled to 0..1 over its non-null values; 1 where all are equal."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    scaled = {c + suffix: F.when(F.col(c).isNull(), None).when(F.col(f"_max_{c}") == F.col(f"_min_{c}"), 1.0).otherwise((F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}"))) for c in columns}
    return out.withColumns(scaled).drop(*bounds.columns)


def fuse(atoms: DataFrame, r1: DataFrame, r2: DataFrame, top_k: int | None = 10, w_cos: float = W_COS, w_bm25: float = W_BM25, w_access: float = W_ACCESS) -> DataFrame:
    """Both result lists (id, score) joined by id; each signal min-max scaled, a missing one 0."""
    both = r1.select("id", F.col("score").alias("_cos")).join(r2.select("id", F.col("score").alias("_bm")), "id", "full")
    return combine(atoms.join(both, "id"), top_k, w_cos, w_bm25, w_access)


def combine(df: DataFrame, top_k: int | None, w_cos: float = W_COS, w_bm25: float = W_BM25, w_access: float = W_ACCESS) -> DataFrame:
    """Fused ranking of records with _cos and _bm (null: no such signal)."""
    scaled = min_max(df.withColumn("_acc", F.log1p(F.col("access_count").cast("double"))), ["_cos", "_bm", "_acc"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = w_cos * zero("_cos_norm") + w_bm25 * zero("_bm_norm")
    if w_access > 0:
        score = score + w_access * zero("_acc_norm")
    out = scaled.withColumns({"score": score, "tier": F.lit("R3")}).drop("_cos", "_bm", "_acc", "_cos_norm", "_bm_norm", "_acc_norm")
    return ranked(out, top_k)


def fusion(atoms: DataFrame, query: str, vector: list[float], top_k: int | None = 10, strict: bool = True, **weights: float) -> DataFrame:
    """Cosine and BM25 over the same candidates, then fused.

    Both signals are computed on one scan: the cosine is a column beside the records,
    and only matches of the query are joined to it.
    """
    check_top_k(top_k) if top_k is not None else None
    scored = atoms.withColumn("_cos", dot_literal(F.col("embedding"), vector))
    matches = bm25_scores(atoms.select("id", "content"), query, strict).select("id", F.col("score").alias("_bm"))
    both = scored.join(matches, "id", "left").where(F.col("_cos").isNotNull() | F.col("_bm").isNotNull())
    return combine(both, top_k, **weights)
