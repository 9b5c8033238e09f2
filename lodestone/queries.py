"""Every operator as a query over the sample tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.vectors import dot
from lodestone.operators import admin, conflicts, graph, oplog, relay, retrieval
from lodestone.plans import search as plan
from lodestone.schema import EDGE_TYPES, TYPES, valid_timestamp
from lodestone.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PROJECT, SESSION, TAGS, NOW = "src1", "s1", ["del", "para", "und", "reing", "der"], "2024-02-20T00:00:00"
BLINDED = "e7cf46a078fed4fafd0b5e3aff144802b853f8ae459a4f0c14add3314b7cc3a6"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return add


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_KEYWORDS = f"list_filter(regexp_split_to_array(lower(d.text), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({_list(w for w in X.STOPWORDS if len(w) > 2)}, x))"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

ATOMS = f"""
kw AS (SELECT doc_id, {_KEYWORDS} AS k FROM documents d),
atoms AS (
  SELECT 'd' || d.doc_id AS id, d.text AS content, e.embedding::DOUBLE[] AS embedding, d.source AS project_id,
    {_list(TYPES)}[1 + d.doc_id % {len(TYPES)}] AS type, CASE WHEN d.doc_id % 10 = 0 THEN 'global' ELSE 'project' END AS scope,
    d.lang AS category, d.doc_id % 3 = 0 AS enriched, coalesce(l.toxic, 0) = 1 AS invalidated,
    strftime(TIMESTAMP '2024-01-01' + to_hours(d.doc_id::INT), '%Y-%m-%dT%H:%M:%S.000Z') AS created_at,
    CASE WHEN d.doc_id % 5 <> 0 THEN 's' || (d.doc_id % 25) END AS session_id, d.doc_id % 7 AS access_count,
    {_FIRST.format("kw.k")}[1:5] AS tags, d.doc_id AS row_seq
  FROM documents d JOIN kw USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))"""
EDGES = f"""
n AS (SELECT count(*) AS n FROM documents),
edges AS (SELECT o_orderkey AS id, 'd' || (o_orderkey % n) AS a, 'd' || (o_custkey % n) AS b, {_list(EDGE_TYPES)}[1 + o_orderkey % {len(EDGE_TYPES)}] AS edge_type
  FROM orders, n),
pairs AS (SELECT a, b, edge_type FROM edges UNION ALL SELECT b, a, edge_type FROM edges)"""
LOG = """
log AS (
  SELECT *, sha256(client_id || ':' || sequence_no) AS entry_id FROM (
    SELECT event_id, 'c' || user_id AS client_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_no,
      CASE WHEN event_type = 'error' THEN 'invalidate' ELSE 'upsert' END AS op, 'r' || (event_id % 2000) AS record_id,
      sha256('p' || (event_id % 2000 % 5)) AS blinded_project_id, strftime(date_trunc('week', ts)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
      event_type || ':' || event_id AS payload, CASE WHEN user_id % 3 = 0 THEN 'remote' ELSE 'local' END AS source, event_id % 4 = 0 AS pushed
    FROM events))"""
CAND = f"cand AS (SELECT * FROM atoms WHERE project_id = '{PROJECT}' AND NOT invalidated)"
VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS = f"cos AS (SELECT id, list_inner_product(embedding, {VECTOR}) AS s FROM cand WHERE embedding IS NOT NULL)"
TOK = "tok AS (SELECT id, list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM cand)"
ORDER = "ORDER BY score DESC, created_at DESC, row_seq DESC, id"


def term(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def prefix(w: str) -> str:
    return f"len(list_filter(t, lambda x: starts_with(x, '{w}')))"


def phrase(*ws: str) -> str:
    return f"len(list_filter(range(1, greatest(len(t) - {len(ws) - 2}, 1)::BIGINT), lambda i: " + " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(ws)) + "))"


def bm25_sql(parts: list[str], condition: str) -> str:
    """CTEs up to bm (id, s): parts are the phrases' counts, condition is over tf0, tf1, ..."""
    tfs = ", ".join(f"{p} AS tf{i}" for i, p in enumerate(parts))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(parts)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * (tf{i} * 2.2e0) / (tf{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))" for i in range(len(parts)))
    return f"{TOK}, tf AS (SELECT id, len(t) AS len, {tfs} FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {dfs} FROM tf), bm AS (SELECT id, {score} AS s FROM tf, st WHERE {condition})"


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(map(float, S.read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]))


def _cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.candidates(S.atoms(spark, sf_dir), PROJECT)


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "tier")


# scans and filters


@query("list_project", f"WITH {ATOMS}, {CAND} SELECT id, type, scope, created_at, session_id FROM cand ORDER BY created_at DESC, row_seq DESC LIMIT 20")
def list_project(spark, d):
    return admin.list_project(S.atoms(spark, d), PROJECT, False, 20).select("id", "type", "scope", "created_at", "session_id")


@query("get_atom", f"WITH {ATOMS} SELECT id, content, project_id, type, scope, created_at, session_id, array_to_string(tags, ',') AS tags FROM atoms WHERE id = 'd7'")
def get_atom(spark, d):
    return S.atoms(spark, d).where("id = 'd7'").limit(1).select("id", "content", "project_id", "type", "scope", "created_at", "session_id", F.array_join("tags", ",").alias("tags"))


@query("flush_scan", f"WITH {ATOMS} SELECT id, created_at FROM atoms WHERE NOT invalidated")
def flush_scan(spark, d):
    return S.atoms(spark, d).where(~F.col("invalidated")).select("id", "created_at").orderBy(F.col("created_at").desc())


@query("tag_filter", f"WITH {ATOMS} SELECT id, array_to_string(tags, ',') AS tags FROM atoms WHERE project_id = '{PROJECT}' AND NOT invalidated AND list_has_any(list_transform(tags, lambda x: lower(x)), {_list(TAGS)})")
def tag_filter(spark, d):
    return retrieval.candidates(S.atoms(spark, d), PROJECT, tags=[t.upper() for t in TAGS]).select("id", F.array_join("tags", ",").alias("tags"))


@query("session_filter", f"WITH {ATOMS}, {CAND} SELECT id, session_id FROM cand WHERE session_id = '{SESSION}'")
def session_filter(spark, d):
    return retrieval.candidates(S.atoms(spark, d), PROJECT, SESSION).select("id", "session_id")


@query("stale", f"WITH {ATOMS} SELECT id, access_count, created_at FROM atoms WHERE NOT invalidated AND access_count < 3 AND created_at <= strftime(TIMESTAMP '{NOW}' - to_days(30), '%Y-%m-%dT%H:%M:%S.000Z')")
def stale(spark, d):
    return admin.stale(S.atoms(spark, d), NOW, 30, 3).select("id", "access_count", "created_at")


@query("gc_report", f"WITH {ATOMS} SELECT id, left(content, 160) AS content, access_count, created_at FROM atoms WHERE NOT invalidated AND access_count < 2 AND created_at <= strftime(TIMESTAMP '{NOW}' - to_days(45), '%Y-%m-%dT%H:%M:%S.000Z')")
def gc_report(spark, d):
    return admin.gc_report(S.atoms(spark, d), NOW, 45, 2).drop("last_accessed")


@query("unenriched", f"WITH {ATOMS} SELECT id FROM atoms WHERE NOT invalidated AND NOT enriched")
def unenriched(spark, d):
    return admin.unenriched(S.atoms(spark, d)).select("id")


@query("stats", f"WITH {ATOMS} SELECT count(*) AS total, count(*) FILTER (invalidated) AS invalidated, count(*) FILTER (NOT invalidated) AS active, max(created_at) FILTER (enriched) AS last_flush FROM atoms")
def stats(spark, d):
    return admin.stats(S.atoms(spark, d))


@query("session_counts", f"WITH {ATOMS} SELECT project_id, session_id, count(*) AS n FROM atoms GROUP BY 1, 2")
def session_counts(spark, d):
    return S.atoms(spark, d).groupBy("project_id", "session_id").agg(F.count("*").alias("n"))


@query("valid_timestamps", "SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def valid_timestamps(spark, d):
    made = F.when(F.col("event_id") % 3 == 0, "2024-02-29T10:11:12.5Z").when(F.col("event_id") % 3 == 1, "2023-02-29T10:11:12Z").otherwise("2024-02-28 10:11:12")
    return S.read(spark, d, "events").select("event_id", valid_timestamp(made).alias("ok"))


# scope


@query("scope_project", f"WITH {ATOMS}, {CAND} SELECT id, scope FROM cand")
def scope_project(spark, d):
    return admin.in_scope("project", S.atoms(spark, d), PROJECT).select("id", "scope")


@query("scope_global", f"WITH {ATOMS} SELECT id, scope FROM atoms WHERE project_id = 'src0' AND NOT invalidated AND scope = 'global'")
def scope_global(spark, d):
    return admin.in_scope("global", S.atoms(spark, d), "src0").select("id", "scope")


@query("scope_all", f"WITH {ATOMS} SELECT id, scope FROM (SELECT id, scope, created_at, row_seq FROM atoms WHERE project_id = 'src0' AND NOT invalidated ORDER BY created_at DESC, row_seq DESC LIMIT 15)")
def scope_all(spark, d):
    a = S.atoms(spark, d)
    return admin.in_scope("all", a.where("row_seq % 2 = 0"), "src0", a.where("scope = 'global' or row_seq % 2 = 1").withColumn("scope", F.lit("global")), limit=15).select("id", F.when(F.col("row_seq") % 10 == 0, "global").otherwise("project").alias("scope"))


# ranking

_RANK = f"SELECT id, round(s, 6) AS score, '{{}}' AS tier FROM (SELECT c.id, {{}} AS s FROM cand c JOIN {{}} x USING (id) ORDER BY s DESC, created_at DESC, row_seq DESC, id LIMIT {{}})"


@query("r0", f"WITH {ATOMS} SELECT id, 1.0::DOUBLE AS score, 'R0' AS tier FROM atoms WHERE content = (SELECT text FROM documents WHERE doc_id = 3)")
def r0(spark, d):
    text = S.read(spark, d, "documents").where("doc_id = 3").first()["text"]
    return _scored(retrieval.exact(S.atoms(spark, d), text, None))


@query("r1", f"WITH {ATOMS}, {CAND}, {COS} " + _RANK.format("R1", "x.s", "cos", 10))
def r1(spark, d):
    return _scored(retrieval.cosine(_cand(spark, d), _vector(spark, d), 10))


@query("knn_project", f"WITH {ATOMS}, cand AS (SELECT * FROM atoms WHERE NOT invalidated), {COS} SELECT id, project_id, rank, round(s, 6) AS score FROM (SELECT c.id, c.project_id, x.s, row_number() OVER (PARTITION BY c.project_id ORDER BY x.s DESC, c.id) AS rank FROM cand c JOIN cos x USING (id)) WHERE rank <= 3")
def knn_project(spark, d):
    """The best three of every project: a window filtered by rank, cut down before its shuffle."""
    from pyspark.sql import Window

    a = S.atoms(spark, d).where(~F.col("invalidated") & F.col("embedding").isNotNull())
    s = a.select("id", "project_id", retrieval.dot_literal(F.col("embedding"), _vector(spark, d)).alias("s"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("s").desc(), "id"))
    return s.withColumn("rank", rank).where("rank <= 3").select("id", "project_id", "rank", F.round("s", 6).alias("score"))


@query("r1_index", f"WITH {ATOMS}, cand AS (SELECT * FROM atoms WHERE project_id = '{PROJECT}' AND row_seq // 20 % 5 <> 1 AND row_seq // 20 % 7 <> 2), {COS} " + _RANK.format("R1", "x.s", "cos", 20))
def r1_index(spark, d):
    """R1 over an index, with records inserted, invalidated and deleted after its build, some before and some after an update."""
    from lodestone.operators.store import Store
    from lodestone.operators.vector_index import VectorIndex
    from lodestone.scratch import Cuts

    cuts = Cuts(spark)
    s, a = Store(spark, f"{cuts.base}/store"), cuts.cut(S.atoms(spark, d).select("id", "content", "embedding", "project_id", "type", "scope", "created_at", F.expr("row_seq div 20").alias("k")))
    s.insert(a.where("k % 3 > 0").drop("k"), "2024-01-01T00:00:00.000Z")
    index = VectorIndex(s, threshold=10)
    index.build()
    s.insert(a.where("k % 6 = 0").drop("k"), "2024-01-02T00:00:00.000Z")
    s.mark(a.where("k % 5 = 1 AND k % 6 <> 3").select("id"), "invalidate", "2024-01-03T00:00:00.000Z")
    index.update()
    s.insert(a.where("k % 6 = 3").drop("k"), "2024-01-04T00:00:00.000Z")
    s.mark(a.where("k % 5 = 1 AND k % 6 = 3").select("id"), "invalidate", "2024-01-05T00:00:00.000Z")
    s.mark(a.where("k % 7 = 2").select("id"), "delete", "2024-01-05T00:00:00.000Z")
    # 20 neighbours are more than the build measures, so all cells are read
    return _scored(plan.search(s.atoms(PROJECT), "", PROJECT, "R1", 20, vector=_vector(spark, d), index=index))


def _r2(name: str, text: str, parts: list[str], condition: str, strict: bool = True) -> None:
    @query(name, f"WITH {ATOMS}, {CAND}, {bm25_sql(parts, condition)} " + _RANK.format("R2", "x.s", "bm", 10))
    def run(spark, d):
        return _scored(retrieval.bm25(_cand(spark, d), text, 10, strict))


_r2("r2", "that the", [term("that"), term("the")], "tf0 > 0 AND tf1 > 0")
_r2("r2_or", "shan OR est", [term("shan"), term("est")], "tf0 > 0 OR tf1 > 0")
_r2("r2_phrase", '"of the"', [phrase("of", "the")], "tf0 > 0")
_r2("r2_prefix", "thea* and", [prefix("thea"), term("and")], "tf0 > 0 AND tf1 > 0")
_r2("r2_not", "the NOT ronan", [term("the"), term("ronan")], "tf0 > 0 AND NOT tf1 > 0")
_r2("r2_bag", "what's the, ing?", [term("what"), term("s"), term("the"), term("ing")], "tf0 > 0 OR tf1 > 0 OR tf2 > 0 OR tf3 > 0", strict=False)


@query("r2_index", f"WITH {ATOMS}, {CAND}, {bm25_sql([phrase('of', 'the'), prefix('thea'), term('ronan')], '(tf0 > 0 OR tf1 > 0) AND NOT tf2 > 0')} SELECT id, round(s, 6) AS score, 'R2' AS tier FROM (SELECT c.id, x.s FROM cand c JOIN bm x USING (id) ORDER BY s DESC, created_at DESC, row_seq DESC, id LIMIT 10)")
def r2_index(spark, d):
    """BM25 from the postings of an index over all records."""
    from lodestone.operators.text_index import TextIndex
    from lodestone.scratch import Cuts

    index, a = TextIndex(spark, Cuts(spark).base), S.atoms(spark, d)
    index.add(a)
    return _scored(plan.search(a, '("of the" OR thea*) NOT ronan', PROJECT, "R2", text_index=index))


@query("r2_error", f"WITH {ATOMS} SELECT id, 0.0::DOUBLE AS score, 'R2' AS tier FROM atoms WHERE false")
def r2_error(spark, d):
    return _scored(retrieval.bm25(_cand(spark, d), "memory-safe", 10))


@query("bm25_stats", f"WITH {ATOMS}, {CAND}, {TOK}, w AS (SELECT id, unnest(t) AS term FROM tok) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY 1")
def bm25_stats(spark, d):
    """Document and corpus frequencies; counted per record first, so the shuffle carries sums."""
    one = _cand(spark, d).select("id", F.explode(X.tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    return one.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("cf"))


_SCALE = "(CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END)"


def _fused(w_access: float) -> str:
    return f"""WITH {ATOMS}, {CAND}, {COS}, {bm25_sql([term("that"), term("the")], "tf0 > 0 AND tf1 > 0")},
      un AS (SELECT id FROM cos UNION SELECT id FROM bm), cosn AS (SELECT id, {_SCALE} AS v FROM cos), bmn AS (SELECT id, {_SCALE} AS v FROM bm),
      acc AS (SELECT id, {_SCALE} AS v FROM (SELECT c.id, ln(c.access_count + 1) AS s FROM cand c JOIN un USING (id)))
      SELECT id, round(s, 6) AS score, 'R3' AS tier FROM (
        SELECT c.id, 0.55 * coalesce(cosn.v, 0) + 0.35 * coalesce(bmn.v, 0) + {w_access} * acc.v AS s
        FROM un JOIN cand c USING (id) LEFT JOIN cosn USING (id) LEFT JOIN bmn USING (id) JOIN acc USING (id)
        ORDER BY s DESC, created_at DESC, row_seq DESC, c.id LIMIT 10)"""


@query("r3", _fused(0.1))
def r3(spark, d):
    return _scored(plan.search(S.atoms(spark, d), "that the", PROJECT, vector=_vector(spark, d)))


@query("r3_access", _fused(1.0))
def r3_access(spark, d):
    return _scored(plan.search(S.atoms(spark, d), "that the", PROJECT, vector=_vector(spark, d), w_access=1.0))


@query("fuse_lists", _fused(0.1))
def fuse_lists(spark, d):
    c = _cand(spark, d)
    return _scored(retrieval.fuse(c, retrieval.cosine(c, _vector(spark, d), None), retrieval.bm25(c, "that the", None)))


@query("r1_fallback", f"WITH {ATOMS}, {CAND}, {bm25_sql([term('that'), term('the')], 'tf0 > 0 AND tf1 > 0')} " + _RANK.format("R2", "x.s", "bm", 10))
def r1_fallback(spark, d):
    return _scored(plan.search(S.atoms(spark, d), "that the", PROJECT, "R1"))


@query("minmax", f"WITH {ATOMS}, {CAND}, {COS} SELECT id, round({_SCALE}, 6) AS v FROM cos")
def minmax(spark, d):
    c = retrieval.cosine(_cand(spark, d), _vector(spark, d), None).select("id", "score")
    return retrieval.min_max(c, ["score"]).select("id", F.round("score_norm", 6).alias("v"))


@query("search_filtered", f"WITH {ATOMS}, cand AS (SELECT * FROM atoms WHERE project_id = 'src1' AND NOT invalidated AND session_id IN ('s1', 's21', 's6')), {COS} " + _RANK.format("R1", "x.s", "cos", 5))
def search_filtered(spark, d):
    return _scored(plan.search(S.atoms(spark, d).withColumn("session_id", F.when(F.col("session_id").isin("s1", "s21", "s6"), "x")), "", "src1", "R1", 5, vector=_vector(spark, d), session_id="x"))


@query("scope_search", f"WITH {ATOMS}, cand AS (SELECT * FROM atoms WHERE project_id = 'src0' AND NOT invalidated), {COS} SELECT id, round(s, 6) AS score, 'R1' AS tier FROM (SELECT c.id, c.scope, x.s FROM cand c JOIN cos x USING (id) ORDER BY s DESC, created_at DESC, row_seq DESC, id LIMIT 12) WHERE scope = 'global'")
def scope_search(spark, d):
    return _scored(plan.search_in_scope("global", S.atoms(spark, d), "", "src0", 12, tier="R1", vector=_vector(spark, d)))


@query("prime", f"WITH {ATOMS}, {CAND}, {bm25_sql([term('and')], 'tf0 > 0')} SELECT id, round(s, 6) AS score, tier, type, scope, invalidated FROM (SELECT c.*, x.s, 'R2' AS tier FROM cand c JOIN bm x USING (id) ORDER BY s DESC, created_at DESC, row_seq DESC, id LIMIT 8)")
def prime(spark, d):
    return plan.hits(plan.search(S.atoms(spark, d), "and", PROJECT, top_k=8)).select("id", F.round("score", 6).alias("score"), "tier", "type", "scope", "invalidated")


# near-equal records


@query("conflicts", f"WITH {ATOMS}, cand AS (SELECT * FROM atoms WHERE NOT invalidated), {COS} SELECT c.id, round_even(s, 4) AS similarity, left(content, 160) || CASE WHEN length(content) > 160 THEN '…' ELSE '' END AS snippet FROM cand c JOIN cos USING (id) WHERE s >= 0.2 AND c.id <> 'd0'")
def conflicts_query(spark, d):
    return conflicts.conflicts(S.atoms(spark, d).where(~F.col("invalidated")), _vector(spark, d), 0.2, "d0")


@query("superseded", f"WITH {ATOMS}, cand AS (SELECT * FROM atoms WHERE NOT invalidated), {COS} SELECT id FROM cos WHERE s >= 0.25")
def superseded(spark, d):
    return conflicts.superseded(S.atoms(spark, d).where(~F.col("invalidated")), _vector(spark, d), 0.25)


NEAR_PAIRS = f"WITH {ATOMS}, v AS (SELECT * FROM atoms WHERE NOT invalidated AND embedding IS NOT NULL) SELECT project_id, id_a, id_b, round(s, 6) AS similarity FROM (SELECT a.project_id, a.id AS id_a, b.id AS id_b, list_inner_product(a.embedding, b.embedding) AS s FROM v a JOIN v b ON a.project_id = b.project_id AND a.id < b.id) WHERE s >= 0.3"


@query("all_pairs_dup", NEAR_PAIRS)
def all_pairs_dup(spark, d):
    return conflicts.all_pairs(S.atoms(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query("all_pairs_cells", NEAR_PAIRS)
def all_pairs_cells(spark, d):
    """The same join in many small cells, as projects of any size above block_rows have them."""
    return conflicts.all_pairs(S.atoms(spark, d), 0.3, block_rows=10).withColumn("similarity", F.round("similarity", 6))


# text


@query("keywords", f"SELECT doc_id, array_to_string({_FIRST.format('k')}, ',') AS keywords FROM (SELECT doc_id, {_KEYWORDS} AS k FROM documents d)")
def keywords(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.array_join(X.keywords(F.col("text")), ",").alias("keywords"))


# runs of word characters alternate with what stands between; capitalised words stay together over white space alone
_RUNS = "regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+|[^\\p{L}\\p{N}_\\p{M}]+')"
_CHAINS = f"string_split(array_to_string(list_transform({_RUNS}, lambda x: CASE WHEN regexp_full_match(x, '[A-Z][a-zA-Z]+') OR regexp_full_match(x, '[ \\t\\n\\x0B\\f\\r]+') THEN x ELSE chr(1) END), ''), chr(1))"
_ENTITIES = f"list_filter(list_transform({_CHAINS}, lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '')"


@query("entities", f"SELECT doc_id, array_to_string({_FIRST.format('e')}, ',') AS entities FROM (SELECT doc_id, {_ENTITIES} AS e FROM documents)")
def entities(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.array_join(X.entities(F.col("text")), ",").alias("entities"))


@query("tags", f"WITH {ATOMS} SELECT id, array_to_string(tags, ',') AS tags FROM atoms")
def tags(spark, d):
    return S.read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce(F.array_join(X.tags(F.array().cast("array<string>"), X.keywords(F.col("text"))), ","), F.lit("")).alias("tags"))


@query("mirror_lines", f"WITH {ATOMS}, {CAND} SELECT category, created_at, id, '- ' || replace(regexp_replace(content, '\\r\\n|\\r|\\n', ' ', 'g'), '<!--', '<!- -') AS line FROM cand")
def mirror_lines(spark, d):
    return admin.mirror_rows(S.atoms(spark, d), PROJECT)


@query("mirror_counts", f"WITH {ATOMS}, {CAND} SELECT category, count(*) AS n FROM cand GROUP BY 1")
def mirror_counts(spark, d):
    return admin.mirror_counts(S.atoms(spark, d), PROJECT)


@query("category_names", "SELECT p_partkey, coalesce(nullif(left(regexp_replace(lower(trim(p_name)), '[^a-z0-9_-]', '', 'g'), 64), ''), 'notes') AS category FROM part")
def category_names(spark, d):
    return S.read(spark, d, "part").select("p_partkey", X.category(F.col("p_name")).alias("category"))


# graph

_STEP = "l{n} AS (SELECT DISTINCT b AS id FROM pairs JOIN l{p} ON pairs.a = l{p}.id WHERE b NOT IN (SELECT id FROM l0{seen}){types})"


def _bfs(depth: int, types: str = "") -> str:
    levels, seen = ["l0 AS (SELECT 'd1' AS id)"], ""
    for n in range(1, depth + 1):
        levels.append(_STEP.format(n=n, p=n - 1, seen=seen, types=types))
        seen += f" UNION ALL SELECT id FROM l{n}"
    return ", ".join(levels)


@query("bfs_1", f"WITH {EDGES}, {_bfs(1)} SELECT id, 1 AS depth FROM l1")
def bfs_1(spark, d):
    return graph.reach(S.edges(spark, d), spark.createDataFrame([("d1",)], "root string"), 1).where("depth > 0").select("id", "depth")


@query("bfs_2", f"WITH {EDGES}, {_bfs(2)} SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2")
def bfs_2(spark, d):
    return graph.reach(S.edges(spark, d), spark.createDataFrame([("d1",)], "root string"), 2).where("depth > 0").select("id", "depth")


@query("bfs_6", f"WITH {EDGES}, {_bfs(6)} " + " UNION ALL ".join(f"SELECT id, {n} AS depth FROM l{n}" for n in range(1, 7)))
def bfs_6(spark, d):
    """Depth 6 over an adjacency table, a fifth of the edges written after it was built."""
    from lodestone.operators.adjacency import Adjacency
    from lodestone.operators.store import Store
    from lodestone.scratch import Cuts

    store, edges = Store(spark, Cuts(spark).base), S.edges(spark, d)
    store.append("kg_edges", edges.where("id % 5 > 0"))
    table = Adjacency(store)
    table.build()
    store.append("kg_edges", edges.where("id % 5 = 0"))
    return graph.reach(table, spark.createDataFrame([("d1",)], "root string"), 6).where("depth > 0").select("id", "depth")


@query("bfs_typed", f"WITH {ATOMS}, {EDGES}, {_bfs(3, " AND edge_type IN ('blocks', 'causal', 'depends_on')")} SELECT a.id, a.type FROM atoms a WHERE id IN (SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM l3)")
def bfs_typed(spark, d):
    return graph.connected(S.edges(spark, d), S.atoms(spark, d), "d1", 3, ["blocks", "causal", "depends_on"]).select("id", "type")


@query("traverse_edges", f"WITH {EDGES}, {_bfs(2)} SELECT id, a AS from_atom_id, b AS to_atom_id, edge_type FROM edges WHERE a IN (SELECT id FROM l0 UNION SELECT id FROM l1) OR b IN (SELECT id FROM l0 UNION SELECT id FROM l1)")
def traverse_edges(spark, d):
    return graph.traverse(S.edges(spark, d), S.atoms(spark, d), spark.createDataFrame([("d1",)], "root string"), 2)[1].select("id", "from_atom_id", "to_atom_id", "edge_type")


@query("traverse_nodes", f"WITH {ATOMS}, {EDGES}, {_bfs(2)} SELECT a.id, a.project_id FROM atoms a WHERE id IN (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2)")
def traverse_nodes(spark, d):
    return graph.traverse(S.edges(spark, d), S.atoms(spark, d), spark.createDataFrame([("d1",)], "root string"), 2)[0].select("id", "project_id")


@query("graph_entity", f"WITH {ATOMS}, {CAND}, {EDGES}, {COS}, roots AS (SELECT c.id FROM cand c JOIN cos x USING (id) ORDER BY x.s DESC, created_at DESC, row_seq DESC, c.id LIMIT 3), near AS (SELECT id FROM roots UNION SELECT b FROM pairs JOIN roots ON a = roots.id) SELECT a.id, a.type FROM atoms a WHERE id IN (SELECT id FROM near)")
def graph_entity(spark, d):
    a = S.atoms(spark, d)
    roots = plan.search(a, "", PROJECT, "R1", 3, vector=_vector(spark, d)).select(F.col("id").alias("root"))
    return graph.traverse(S.edges(spark, d), a, roots, 1)[0].select("id", "type")


@query("graph_expand", f"""WITH {ATOMS}, {CAND}, {EDGES}, {COS},
  top AS (SELECT c.id, x.s, 1 AS own FROM cand c JOIN cos x USING (id) ORDER BY x.s DESC, created_at DESC, row_seq DESC, c.id LIMIT 6),
  seed AS (SELECT t.id, s FROM top t JOIN atoms USING (id) ORDER BY s DESC, created_at DESC, row_seq DESC, t.id LIMIT 3),
  more AS (SELECT b AS id, max(s * 0.7) AS s, 0 AS own FROM pairs JOIN seed ON a = seed.id WHERE b <> a GROUP BY 1),
  one AS (SELECT id, max(s) AS s FROM (SELECT * FROM top UNION ALL SELECT m.* FROM more m JOIN atoms USING (id)) GROUP BY 1)
  SELECT id, round(s, 6) AS score, 'R1' AS tier FROM (SELECT o.id, o.s FROM one o JOIN atoms USING (id) ORDER BY o.s DESC, created_at DESC, row_seq DESC, o.id LIMIT 6)""")
def graph_expand(spark, d):
    return _scored(plan.search(S.atoms(spark, d), "", PROJECT, "R1", 6, vector=_vector(spark, d), edges=S.edges(spark, d), graph_expand=True))


@query("triples_at", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 28 + 1 <= 14 AND (c_custkey % 3 = 0 OR c_custkey % 28 + 3 > 14)")
def triples_at(spark, d):
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad(n.cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    c = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), day(F.col("c_custkey") % 28 + 1).alias("valid_from"), F.when(F.col("c_custkey") % 3 != 0, day(F.col("c_custkey") % 28 + 3)).alias("valid_to"))
    return graph.valid_at(c, "2024-01-14T00:00:00Z").select("id")


# log and relay


@query("oplog_fold", f"""WITH {LOG} SELECT blinded_project_id, record_id, bool_or(op = 'invalidate') AS invalidated, count(*) AS n_entries, count(*) FILTER (op = 'upsert') AS n_upserts, count(*) FILTER (op = 'upsert') = 0 AS tombstone,
  coalesce(arg_max(entry_id, (ts, entry_id)) FILTER (op = 'upsert'), arg_min(entry_id, (ts, entry_id)) FILTER (op = 'invalidate')) AS entry_id,
  coalesce(arg_max(payload, (ts, entry_id)) FILTER (op = 'upsert'), arg_min(payload, (ts, entry_id)) FILTER (op = 'invalidate')) AS payload FROM log GROUP BY 1, 2""")
def oplog_fold(spark, d):
    return oplog.fold(S.oplog(spark, d)).select("blinded_project_id", "record_id", "invalidated", "n_entries", "n_upserts", "tombstone", "entry_id", F.col("payload").cast("string").alias("payload"))


@query("oplog_winner", f"WITH {LOG} SELECT record_id, arg_max(client_id, (ts, entry_id)) AS client_id, max(ts) AS ts FROM log WHERE op = 'upsert' GROUP BY 1")
def oplog_winner(spark, d):
    return oplog.fold(S.oplog(spark, d)).where("n_upserts > 0").select("record_id", "client_id", "ts")


@query("oplog_conflicts", f"WITH {LOG}, w AS (SELECT blinded_project_id, record_id, max(ts) AS ts, arg_max(entry_id, (ts, entry_id)) AS winner, arg_max(client_id, (ts, entry_id)) AS wc FROM log WHERE op = 'upsert' GROUP BY 1, 2) SELECT record_id, winner, count(*) AS n_rivals FROM w JOIN log l USING (blinded_project_id, record_id, ts) WHERE l.op = 'upsert' AND l.client_id <> wc GROUP BY 1, 2")
def oplog_conflicts(spark, d):
    return oplog.conflicts(S.oplog(spark, d)).drop("blinded_project_id")


_WINNERS = "w AS (SELECT blinded_project_id, record_id, max(ts) AS ts, arg_max(entry_id, (ts, entry_id)) AS winner, arg_max(client_id, (ts, entry_id)) AS wc FROM log WHERE op = 'upsert' GROUP BY 1, 2)"
_RIVALS = "r AS (SELECT l.*, winner, wc FROM w JOIN log l USING (blinded_project_id, record_id, ts) WHERE l.op = 'upsert'), c AS (SELECT DISTINCT blinded_project_id, record_id, winner FROM r WHERE client_id <> wc)"


@query("conflict_lines", f"""WITH {LOG}, {_WINNERS}, {_RIVALS}
  SELECT record_id, 0 AS n, '## conflict: record_id=' || record_id AS line FROM c UNION ALL SELECT record_id, 1, '- resolved_by: latest ts, then entry_id (winner=' || winner || ')' FROM c
  UNION ALL SELECT record_id, CASE WHEN entry_id = r.winner THEN 2 ELSE 3 END, '- entry_id=' || entry_id || ' client_id=' || client_id || ' seq=' || sequence_no || ' ts=' || ts || ' op=' || op FROM r JOIN c USING (blinded_project_id, record_id) WHERE client_id <> wc OR entry_id = r.winner""")
def conflict_lines(spark, d):
    return oplog.conflict_lines(S.oplog(spark, d)).select("record_id", "n", "line")


@query("oplog_dedup", f"WITH {LOG} SELECT entry_id, record_id, op FROM log WHERE event_id % 3 = 0")
def oplog_dedup(spark, d):
    r = S.relay(spark, d)
    third = (F.col("ingest_seq") - 1) % 3 == 0
    batch = r.unionByName(r.where(third).withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000))
    return oplog.insert_or_ignore(r.where(~third), batch, "ingest_seq").select("entry_id", "record_id", "op")


@query("next_seq", f"WITH {LOG} SELECT client_id, max(sequence_no) + 1 AS next_seq FROM log GROUP BY 1")
def next_seq(spark, d):
    return oplog.next_sequence(S.oplog(spark, d))


@query("unpushed", f"WITH {LOG} SELECT entry_id, sequence_no FROM log WHERE blinded_project_id = sha256('p0') AND client_id = 'c1' AND source = 'local' AND NOT pushed")
def unpushed(spark, d):
    import hashlib

    return oplog.unpushed(S.oplog(spark, d), hashlib.sha256(b"p0").hexdigest(), "c1").select("entry_id", "sequence_no")


@query("mark_pushed", f"WITH {LOG} SELECT entry_id, pushed OR (client_id = 'c1' AND source = 'local' AND sequence_no <= CASE WHEN blinded_project_id = sha256('p0') THEN 5 WHEN blinded_project_id = sha256('p1') THEN 9 ELSE 0 END) AS pushed FROM log")
def mark_pushed(spark, d):
    import hashlib

    from lodestone import schema

    at = [(hashlib.sha256(p.encode()).hexdigest(), direction, "relay", n, None, "2024") for p, direction, n in (("p0", "push", 5), ("p1", "push", 9), ("p2", "pull", 9))]
    return oplog.mark_pushed(S.oplog(spark, d), spark.createDataFrame(at, schema.CURSORS), "c1").select("entry_id", "pushed")


@query("entries_for_record", f"WITH {LOG} SELECT entry_id, ts, op FROM log WHERE record_id = 'r5'")
def entries_for_record(spark, d):
    import hashlib

    return oplog.entries_for_record(S.oplog(spark, d), hashlib.sha256(b"p0").hexdigest(), "r5").select("entry_id", "ts", "op")


@query("receipts", f"WITH {LOG} SELECT 'write' AS op, ts, sha256(record_id || ':' || 'demo') AS record_hash FROM (SELECT * FROM log WHERE blinded_project_id = sha256('p1') AND op = 'upsert' ORDER BY ts DESC, entry_id DESC LIMIT 50)")
def receipts(spark, d):
    import hashlib

    return oplog.receipts(S.oplog(spark, d), hashlib.sha256(b"p1").hexdigest(), "demo", "write", 50).select("op", "ts", "record_hash")


@query("wire_entries", f"WITH {LOG} SELECT entry_id, client_id, sequence_no, op, record_id, ts, base64(payload::BLOB) AS payload FROM log")
def wire_entries(spark, d):
    w = oplog.to_wire(oplog.from_wire(oplog.to_wire(S.oplog(spark, d))))
    return w.drop("blinded_project_id")


@query("backfill", f"WITH {ATOMS}, r AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS sequence_no, invalidated FROM atoms WHERE project_id = '{PROJECT}' AND row_seq % 2 = 1) SELECT sha256('me:' || sequence_no) AS entry_id, sequence_no, CASE WHEN invalidated THEN 'invalidate' ELSE 'upsert' END AS op, id AS record_id FROM r")
def backfill(spark, d):
    a = S.atoms(spark, d)
    bpid = "0" * 64
    known = a.where("row_seq % 2 = 0").select(F.lit("other").alias("client_id"), F.lit(1).cast("long").alias("sequence_no"), F.col("id").alias("record_id"), F.lit(bpid).alias("blinded_project_id"))
    return oplog.backfill(a, known, PROJECT, "me", bpid).select("entry_id", "sequence_no", "op", "record_id")


@query("relay_page", f"WITH {LOG}, p AS (SELECT * FROM log WHERE blinded_project_id = sha256('p2') AND event_id + 1 > 500 ORDER BY event_id LIMIT 101), q AS (SELECT * FROM p ORDER BY event_id LIMIT 100) SELECT event_id + 1 AS ingest_seq, record_id, (SELECT count(*) > 100 FROM p) AS has_more, (SELECT (max(event_id) + 1)::VARCHAR FROM q) AS next_cursor FROM q")
def relay_page(spark, d):
    import hashlib

    return relay.read_page(S.relay(spark, d), hashlib.sha256(b"p2").hexdigest(), "500", 100).select("ingest_seq", "record_id", "has_more", "next_cursor")


@query("relay_cursor", "SELECT (max(event_id) + 1)::VARCHAR AS cursor FROM events WHERE event_id % 2000 % 5 = 3")
def relay_cursor(spark, d):
    import hashlib

    return relay.last_cursor(S.relay(spark, d), hashlib.sha256(b"p3").hexdigest())


@query("relay_append", f"WITH {LOG}, n AS (SELECT max(event_id) + 1 AS m FROM log WHERE event_id % 2 = 0), f AS (SELECT *, row_number() OVER (ORDER BY client_id, sequence_no, entry_id) AS k FROM log WHERE event_id % 2 = 1) SELECT m + k AS ingest_seq, entry_id FROM f, n")
def relay_append(spark, d):
    r = S.relay(spark, d)
    return relay.append(r.where("ingest_seq % 2 = 1"), r.drop("ingest_seq")).select("ingest_seq", "entry_id")


@query("batch_check", "SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN event_id % 7 = 1 THEN 'op' WHEN event_id % 7 = 2 THEN 'payload' WHEN event_id % 7 = 3 THEN 'project mismatch' WHEN event_id % 7 = 4 THEN 'blinded_project_id' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'batch size', count(*) FROM events HAVING count(*) > 1000")
def batch_check(spark, d):
    k, good = F.col("event_id") % 7, "a" * 64
    rows = S.read(spark, d, "events").select(F.when(k == 4, "nothing").when(k == 3, "b" * 64).otherwise(good).alias("blinded_project_id"), F.when(k == 1, "drop").otherwise("upsert").alias("op"), F.when(k == 2, "!!").otherwise("aGk=").alias("payload"))
    return relay.check_batch(rows, good)


@query("audit_totals", f"WITH {LOG} SELECT blinded_project_id, count(*) AS entry_count, sum(length(payload)) AS byte_count, 'ok' AS status FROM log GROUP BY 1")
def audit_totals(spark, d):
    return relay.audit(S.relay(spark, d), "2024-01-01T00:00:00Z", "t", "push", "ok").select("blinded_project_id", "entry_count", "byte_count", "status")


@query("rate_window", """WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events),
  w AS (SELECT user_id, min(s) AS a FROM e GROUP BY 1 UNION ALL SELECT w.user_id, min(e.s) FROM w JOIN e ON e.user_id = w.user_id AND e.s >= w.a + 3600 GROUP BY w.user_id)
  SELECT w.user_id, w.a AS window_start, count(*) AS requests, greatest(count(*) - 1, 0) AS rejected FROM w JOIN e ON e.user_id = w.user_id AND e.s >= w.a AND e.s < w.a + 3600 GROUP BY 1, 2""")
def rate_window(spark, d):
    return relay.rate_windows(S.read(spark, d, "events"), ["user_id"], "ts", 1, 3600)


# capture

_K = "(conv_id * 31 + turn)"
_STATUS = f"CASE WHEN {_K} % 17 = 3 OR {_K} % 19 = 4 THEN 'malformed' WHEN {_K} % 11 = 5 OR trim(text) = '' THEN 'malformed' WHEN conv_id % 3 = 2 THEN 'foreign' WHEN {_K} % 13 = 6 THEN 'secret' ELSE 'written' END"
_LINES = f"SELECT *, {_STATUS} AS status FROM conversations WHERE {_K} % 17 = 3 OR {_K} % 19 = 4 OR {_K} % 23 <> 7"


def _captured(spark, d):
    lines = S.queue(spark, d)
    two = lines.withColumn("value", F.replace(F.replace(F.col("value"), F.lit('"project_id":"p0"'), F.lit('"project_id":"p"')), F.lit('"project_id":"p1"'), F.lit('"project_id":"p"')))
    return admin.captured(two, "p", "2025-01-01T00:00:00.000Z")


@query("drain_status", f"SELECT status, created_at, n FROM (SELECT status, CASE WHEN status <> 'malformed' AND {_K} % 4 <> 0 THEN '2024-05-06T07:08:09Z' WHEN status <> 'malformed' THEN '2025-01-01T00:00:00.000Z' END AS created_at, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2)")
def drain_status(spark, d):
    return _captured(spark, d).groupBy("status", F.when(F.col("status") != "malformed", F.col("created_at")).alias("created_at")).agg(F.count("*").alias("n"))


@query("drain_counts", f"SELECT status, count(*) AS n FROM ({_LINES}) GROUP BY 1")
def drain_counts(spark, d):
    return admin.drain_counts(_captured(spark, d))


@query("capture_lines", """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'user_prompt' ELSE 'unknown' END AS source,
  CASE WHEN conv_id % 3 = 0 THEN 'a' || turn ELSE 'unknown' END AS agent, CASE WHEN conv_id % 3 = 1 THEN 'TASK-' || turn END AS task_id,
  left(CASE WHEN conv_id % 3 = 1 THEN 'TASK-' || turn || ' ' || replace(replace(text, chr(13), ''), chr(10), ' ') ELSE replace(replace(text, chr(13), ''), chr(10), ' ') END, 100000) AS content
  FROM conversations WHERE text <> '' AND conv_id % 5 <> 4""")
def capture_lines(spark, d):
    """Hook inputs (JSON of two forms, and plain text) as queue lines, read back field by field."""
    from lodestone.sources.spool import capture_lines

    turn = F.col("turn").cast("string")
    json_of = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    shape = F.col("conv_id") % 3
    made = F.when(shape == 0, json_of(hook_event_name=F.lit("Stop"), agent_name=F.concat(F.lit("a"), turn), text=F.col("text"))).when(shape == 1, json_of(hook_event_name=F.lit("UserPromptSubmit"), summary=F.lit(""), prompt=F.concat(F.lit("TASK-"), turn, F.lit(" "), F.col("text")))).otherwise(F.col("text"))
    inputs = S.read(spark, d, "conversations").where("text <> ''").select(made.alias("input"), F.when(F.col("conv_id") % 5 != 4, F.lit("p")).alias("project_id"), F.concat_ws(":", "conv_id", "turn").alias("session_id"))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    at = F.split(field("session_id"), ":")
    return capture_lines(inputs, "2024-05-06T07:08:09Z").select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), *[field(n).alias(n) for n in ("source", "agent", "task_id", "content")])


@query("guarded_merge", """SELECT doc_id, doc_id % 4 <> 2 AS merged, CASE WHEN doc_id % 4 IN (0, 3) THEN left(text, 1000) WHEN doc_id % 4 = 1 THEN 'old' END AS summary,
  CASE WHEN doc_id % 4 IN (0, 1) THEN '["' || lang || '","' || source || '"]' END AS entities, CASE WHEN doc_id % 4 IN (0, 1, 3) THEN 'kept' END AS own FROM documents""")
def guarded_merge(spark, d):
    """Model answers, fenced and bare, with fields of a wrong kind or no JSON at all, merged into metadata."""
    from lodestone.functions.enrichment import merged

    docs, k = S.read(spark, d, "documents"), F.col("doc_id") % 4
    listed = F.array("lang", "source")
    full = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("summary"), listed.alias("entities"))), F.lit("\n```"))
    odd = F.to_json(F.struct(F.col("doc_id").alias("summary"), listed.alias("entities"), F.array(F.lit(1)).alias("keywords")))
    answer = F.when(k == 0, full).when(k == 1, odd).when(k == 2, "no answer").otherwise(F.to_json(F.struct(F.col("text").alias("summary"), F.lit("x").alias("entities"))))
    out = docs.select("doc_id", merged(F.lit('{"own": "kept", "summary": "old"}'), answer, "2024-05-06T07:08:09Z").alias("m"))
    field = lambda name: F.get_json_object("m", f"$.{name}").alias(name)
    return out.select("doc_id", F.col("m").isNotNull().alias("merged"), field("summary"), field("entities"), field("own"))


@query("snapshot", f"WITH {ATOMS} SELECT id, content, CASE WHEN row_seq % 4 = 1 THEN true WHEN row_seq % 4 = 2 THEN false ELSE false END AS invalidated, CASE WHEN row_seq % 6 = 0 THEN 2 ELSE 0 END AS access_count FROM atoms WHERE row_seq % 9 <> 8")
def snapshot(spark, d):
    """Records folded from inserts, invalidations, restores, deletions and accesses."""
    from lodestone.operators import store

    a = S.atoms(spark, d)
    names = [c.split()[0] for c in store.EVENTS.split(", ")]
    event = lambda rows, what, at: rows.select(*[F.lit(what).alias(n) if n == "event" else F.lit(at).alias(n) if n == "at" else F.col("row_seq").alias(n) if n == "seq" else F.col(n) for n in names])
    events = event(a, "insert", "2024-01-01T00:00:00.000Z").unionByName(event(a.where("row_seq % 4 in (1, 2)"), "invalidate", "2024-02-01T00:00:00.000Z")).unionByName(event(a.where("row_seq % 4 = 2"), "restore", "2024-03-01T00:00:00.000Z")).unionByName(event(a.where("row_seq % 9 = 8"), "delete", "2024-04-01T00:00:00.000Z"))
    read = a.where("row_seq % 6 = 0").select(F.col("id").alias("atom_id"), F.lit("2024-05-01T00:00:00.000Z").alias("at"))
    return store.snapshot(events, read.unionAll(read)).select("id", "content", "invalidated", "access_count")


@query("store_snapshot", f"WITH {ATOMS} SELECT id, content, project_id, created_at, row_seq % 4 = 1 AS invalidated FROM atoms WHERE row_seq % 9 <> 8 OR row_seq % 2 = 0")
def store_snapshot(spark, d):
    """Records through the store: inserted, marked, deleted, some inserted again."""
    from lodestone.operators.store import Store
    from lodestone.scratch import Cuts

    s, a = Store(spark, Cuts(spark).base), S.atoms(spark, d)
    batch = a.select("id", "content", "project_id", "type", "scope", "created_at", "session_id")
    s.insert(batch, "2024-01-01T00:00:00.000Z")
    s.mark(a.where("row_seq % 4 in (1, 2)").select("id"), "invalidate", "2024-02-01T00:00:00.000Z")
    s.mark(a.where("row_seq % 4 = 2").select("id"), "restore", "2024-02-01T00:00:00.000Z")
    s.mark(a.where("row_seq % 9 = 8").select("id"), "delete", "2024-03-01T00:00:00.000Z")
    s.insert(a.where("row_seq % 9 = 8 and row_seq % 2 = 0").select("id", "content", "project_id", "type", "scope", "created_at", "session_id"), "2024-04-01T00:00:00.000Z")
    return s.atoms().select("id", "content", "project_id", "created_at", "invalidated")


@query("store_compacted", f"WITH {ATOMS} SELECT id, content, project_id, created_at, row_seq % 4 = 1 AS invalidated FROM atoms WHERE row_seq % 9 <> 8 OR row_seq % 2 = 0")
def store_compacted(spark, d):
    """Records through a store that is compacted between its writes, and vacuumed once."""
    from lodestone.operators.store import Store
    from lodestone.scratch import Cuts

    s, a = Store(spark, Cuts(spark).base), S.atoms(spark, d)
    batch = lambda which: a.where(which).select("id", "content", "project_id", "type", "scope", "created_at", "session_id")
    s.insert(batch("row_seq % 5 > 0"), "2024-01-01T00:00:00.000Z")
    s.compact()
    s.insert(batch("row_seq % 5 = 0"), "2024-01-01T00:00:00.000Z")
    s.mark(a.where("row_seq % 4 in (1, 2)").select("id"), "invalidate", "2024-02-01T00:00:00.000Z")
    s.compact()
    s.vacuum()
    s.mark(a.where("row_seq % 4 = 2").select("id"), "restore", "2024-02-01T00:00:00.000Z")
    s.mark(a.where("row_seq % 9 = 8").select("id"), "delete", "2024-03-01T00:00:00.000Z")
    s.compact()
    s.insert(batch("row_seq % 9 = 8 and row_seq % 2 = 0"), "2024-04-01T00:00:00.000Z")
    return s.atoms().select("id", "content", "project_id", "created_at", "invalidated")


@query("vector_norms", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm2 FROM embeddings")
def vector_norms(spark, d):
    return S.read(spark, d, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"))
