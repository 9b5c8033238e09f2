"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

from lodestone.llm.licenses import OPENING, PHRASES, TEMPLATES, template_pattern
from lodestone.llm.lm_scoring import PRIORS
from lodestone.llm.pii import IBAN_SIZES, OTHER
from lodestone.llm.pii import RULES as PII_RULES
from lodestone.llm.secrets import ALLOW, ALPHABETS, KINDS, LEAST_UNLIKE, LIMITS, PAIRS, WINDOW, _units, limit_units
from lodestone.llm.url_filters import ATTRIBUTE, ENTITIES, LINK_TAG, META_TAG, REFRESH, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# near join: exact sets of word runs, all linked classes, components by a recursive query

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN ['text ' || text] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS sh, len(w) > 0 AS ok FROM w),
cls AS (SELECT doc_id, sh, ok, min(doc_id) OVER (PARTITION BY sh, ok) AS rep, count(*) OVER (PARTITION BY sh, ok) AS n_copies FROM s),
reps AS (SELECT rep, any_value(sh) AS sh, any_value(n_copies) AS n_copies, len(any_value(sh)) AS n FROM cls WHERE ok GROUP BY rep),
x AS (SELECT rep, n, n_copies, unnest(sh) AS g FROM reps),
links AS (SELECT a.rep AS a, b.rep AS b, any_value(b.n_copies) AS c FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1),
deg AS (SELECT a AS rep, sum(c)::BIGINT AS docs, count(*) AS classes FROM links GROUP BY 1)
SELECT doc_id, rep AS copy_id, coalesce(class_id, rep) AS class_id, n_copies, n_copies - 1 + coalesce(docs, 0) AS n_links, coalesce(classes, 0) AS n_class_links
FROM cls LEFT JOIN comp USING (rep) LEFT JOIN deg USING (rep)"""

# URL filters: markup edges, components by a recursive query

_HOST, _PATH = "lower(regexp_extract({0}, '^[^:]*?://([^/?#]*)', 1))", "regexp_extract({0}, '^[^:]*?://[^/?#]*([^?#]*)', 1)"


def _rule(field: int, host: str = "host", path: str = "path") -> str:
    cases = "".join(f" WHEN ({host} = '{r[0]}' OR ends_with({host}, '.{r[0]}')) AND starts_with({path}, '{r[1]}') THEN '{(r[0] + r[1], r[2])[field]}'" for r in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow")))
    return f"CASE{cases} END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _attribute(tag: str, name: str) -> str:
    pattern = _quoted(rf"(?i)[\s\"'/]{name}\s*=\s*{ATTRIBUTE}")
    return "(" + " || ".join(f"regexp_extract({tag}, {pattern}, {g})" for g in (1, 2, 3)) + ")"


def _decoded(c: str) -> str:
    for written, sign in ENTITIES:
        c = f"regexp_replace({c}, '(?i){written}', '{sign}', 'g')"
    return c


def _flat(path: str) -> str:
    """Without . and .. segments: a list of one-element lists, reduced from an empty one."""
    return f"""(CASE WHEN {path} = '' THEN '' ELSE '/' || array_to_string(list_reduce([[]::VARCHAR[]] || list_transform(string_split({path}, '/')[2:], lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:-2] WHEN x[1] = '.' THEN acc ELSE acc || x END), '/')
      || CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') AND len(list_reduce([[]::VARCHAR[]] || list_transform(string_split({path}, '/')[2:], lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:-2] WHEN x[1] = '.' THEN acc ELSE acc || x END)) > 0 THEN '/' ELSE '' END END)"""


_T = _decoded("regexp_replace(x, '^\\s+|\\s+$', '', 'g')")
_FOLDER = "CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END"
URLS = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path FROM pages),
j AS (SELECT *, {_rule(0)} AS rule, {_rule(1)} AS action FROM p),
tags AS (SELECT url, path, unnest(list_filter(regexp_extract_all(html, {_quoted(LINK_TAG)}), lambda t: list_contains(regexp_split_to_array(lower({_attribute("t", "rel")}), '\s+'), 'canonical'))) AS t, true AS link FROM p WHERE url LIKE '%://%'
  UNION ALL SELECT url, path, unnest(list_filter(regexp_extract_all(html, {_quoted(META_TAG)}), lambda t: lower({_attribute("t", "http-equiv")}) = 'refresh')), false FROM p WHERE url LIKE '%://%'),
raw AS (SELECT url, path, CASE WHEN link THEN {_attribute("t", "href")} ELSE regexp_extract({_attribute("t", "content")}, {_quoted(REFRESH)}, 1) END AS x FROM tags),
told AS (SELECT url, path, {_T} AS t, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS origin FROM raw),
split AS (SELECT *, regexp_extract(t, '^([^?#]*)', 1) AS own, regexp_extract(t, '^[^?#]*(.*)$', 1) AS rest, {_FOLDER} AS folder, regexp_extract(t, '^[^:]*://[^/?#]*([^?#]*)', 1) AS beyond, regexp_extract(t, '^//[^/?#]*([^?#]*)', 1) AS across FROM told),
links AS (SELECT url AS a, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '(?i)^https?://') THEN regexp_extract(t, '^([^:]*://[^/?#]*)', 1) || {_flat("beyond")} || rest WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || regexp_extract(t, '^(//[^/?#]*)', 1) || {_flat("across")} || rest WHEN starts_with(t, '/') THEN origin || {_flat("own")} || rest
  WHEN starts_with(t, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || t ELSE origin || {_flat("(folder || own)")} || rest END AS b FROM split),
e AS (SELECT DISTINCT a, b FROM links WHERE b IS NOT NULL),
both AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
"""
URLS = (
    URLS.replace("both AS", "pairs AS")
    + rf""", open AS (SELECT DISTINCT url FROM j WHERE action IS NULL AND url IS NOT NULL),
reach AS (SELECT url AS a, url AS b FROM open UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
seen AS (SELECT a, {_rule(1, "h", "q")} AS action FROM (SELECT a, {_HOST.format("b")} AS h, {_PATH.format("b")} AS q FROM reach)),
alias AS (SELECT a AS url, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS v FROM seen GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(action, v, 'allow') AS verdict, action IS NULL AND v IS NOT NULL AS aliased FROM j LEFT JOIN alias ON j.action IS NULL AND j.url = alias.url"""
)

# secrets: matches placed by the running lengths of gaps and matches, windows counted one by one


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, s, s + len(m) AS e, m FROM (
      SELECT doc_id, unnest(whole) AS m, unnest(value) AS v, unnest(list_transform(range(1, len(whole) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: len(g))), 0)))::BIGINT AS s
      FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS value FROM docs)) WHERE len(v) >= {least}"""


_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][kind + 1]"
_WRITE = f"coalesce(string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, kind), '')"
_TABLE = "[" + ", ".join(str(_units(c)) for c in range(WINDOW + 1)) + "]"
_ALLOWED = " OR ".join(f"regexp_matches(m, '{a}')" for a in ALLOW if "\\1" not in a)
_FITS = " OR ".join(f"regexp_matches(m, '{a}')" for a in ALLOW if a.startswith("^") and "\\1" not in a) + " OR m = repeat(left(m, 1), len(m)::INT)"
_REST = "m"
for _piece in ALLOW:
    _REST = _REST if _piece.startswith("^") else f"regexp_replace({_REST}, '{_piece}', '~', 'g')"
_MOST = "CASE" + "".join(f" WHEN regexp_matches(x, '{a}') THEN {limit_units(bits)}" for a, bits in ALPHABETS) + " END"
_PAIR = lambda a, b: f"regexp_full_match(substr(x, k, 2), '{a}{b}')"
_UNLIKE = f"{_PAIR('[A-Za-z]', '[0-9]')} OR {_PAIR('[0-9]', '[A-Za-z]')} OR {_PAIR('[a-z]', '[A-Z]')} OR {_PAIR('[A-Za-z]', '[A-Za-z]')} AND NOT list_contains({PAIRS}, lower(substr(x, k, 2)))"
SECRETS = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans(0, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)} UNION ALL {_spans(1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_spans(2, "[0-9a-f]+", 0, 16)}),
runs AS ({_spans(3, "[A-Za-z0-9+/_=-]{{20,}}".replace("{{", "{").replace("}}", "}"), 0, WINDOW)}),
win AS (SELECT doc_id, s, e, m, unnest(range(0, len(m) - {WINDOW - 1})) AS i FROM runs),
chars AS (SELECT doc_id, s, e, m, i, unnest(string_split(substr(m, i + 1, {WINDOW}), '')) AS ch FROM win),
counted AS (SELECT doc_id, s, e, m, i, ch, count(*) AS c FROM chars GROUP BY ALL),
sums AS (SELECT doc_id, s, e, m, i, sum({_TABLE}[c + 1]) AS u FROM counted GROUP BY ALL),
best AS (SELECT doc_id, 3 AS kind, s, e, m, min(u) AS u FROM sums GROUP BY doc_id, s, e, m),
rest AS (SELECT doc_id, s, e, {_REST} AS r FROM runs WHERE NOT ({_FITS})),
cut AS (SELECT doc_id, s, e, i, substr(r, i + 1, {WINDOW}) AS x FROM (SELECT *, unnest(range(0, len(r) - {WINDOW - 1})) AS i FROM rest)),
odd AS (SELECT *, {_MOST} AS most FROM cut WHERE NOT contains(x, '~') AND len(list_filter(range(1, {WINDOW}), lambda k: {_UNLIKE})) >= {LEAST_UNLIKE}),
signs AS (SELECT doc_id, s, e, i, most, ch, count(*) AS c FROM (SELECT doc_id, s, e, i, most, unnest(string_split(x, '')) AS ch FROM odd) GROUP BY ALL),
random AS (SELECT DISTINCT doc_id, s, e FROM (SELECT doc_id, s, e, i, most, sum({_TABLE}[c + 1]) AS u FROM signs GROUP BY ALL) WHERE u <= most),
more AS (SELECT doc_id, kind, s, e, m FROM best b WHERE (u <= CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {limit_units(LIMITS["hex"])} WHEN regexp_full_match(m, '[A-Za-z]+') THEN {limit_units(LIMITS["letters"])} ELSE {limit_units(LIMITS["mixed"])} END
  AND NOT ({_ALLOWED}) AND NOT ({_FITS}) OR EXISTS (SELECT 1 FROM random r WHERE r.doc_id = b.doc_id AND r.s = b.s AND r.e = b.e)) AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.s <= b.s AND x.e >= b.e)),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_WRITE} AS spans FROM base GROUP BY 1),
a AS (SELECT doc_id, count(*) FILTER (kind = 3) AS n_entropy, {_WRITE} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM docs LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""

# language model: counts by grouping, scores by joins

_CRC = (
    "xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, 8 * len(s)), lambda i: ((ascii(substr(s, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::UBIGINT), "
    "lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"
)
LM = rf"""
WITH crc AS (SELECT doc_id, {_CRC} % 5 = 1 AS held FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w, coalesce(crc.held, false) AS held FROM documents JOIN crc USING (doc_id)),
t AS (SELECT doc_id, held, unnest(list_transform(w, lambda x: 'w' || x) || ['end']) AS w, unnest(['begin'] || list_transform(w, lambda x: 'w' || x)) AS v, unnest([NULL] || (['begin'] || list_transform(w, lambda x: 'w' || x))[:-2]) AS u FROM d),
one AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY 1),
two AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held GROUP BY 1, 2),
three AS (SELECT u, v, w, count(*) AS c FROM t WHERE NOT held AND u IS NOT NULL GROUP BY 1, 2, 3),
ctx AS (SELECT v, count(*) AS c FROM t WHERE NOT held GROUP BY 1),
z AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one),
p AS (SELECT doc_id, t.u, held, one.c AS seen, (coalesce(one.c, 0) + 0.5e0) / (z.n + 0.5e0 * (z.v + 1)) AS p1, z.n, coalesce(two.c, 0) AS c2, coalesce(ctx.c, 0) AS x2, coalesce(three.c, 0) AS c3, coalesce(uv.c, 0) AS x3
  FROM t CROSS JOIN z LEFT JOIN one USING (w) LEFT JOIN two ON two.v = t.v AND two.w = t.w LEFT JOIN ctx ON ctx.v = t.v LEFT JOIN three ON three.u = t.u AND three.v = t.v AND three.w = t.w LEFT JOIN two uv ON uv.v = t.u AND uv.w = t.v),
q AS (SELECT *, (c2 + {PRIORS[0]}::DOUBLE * p1) / (x2 + {PRIORS[0]}::DOUBLE) AS p2 FROM p)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(seen) AS n_known, any_value(n) AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10(CASE WHEN u IS NULL THEN p2 ELSE (c3 + {PRIORS[1]}::DOUBLE * p2) / (x3 + {PRIORS[1]}::DOUBLE) END)), 6) AS score
FROM q GROUP BY doc_id"""

# licences: phrases by place, templates as regular expressions over the words


def _places(phrase: str) -> str:
    return "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + ")"


_FOUND = ", ".join(f"CASE WHEN regexp_matches(s, ' {template_pattern(m)}') THEN '{label}' END" for label, m in TEMPLATES)
_OPENED = " OR ".join(f"regexp_matches(s, ' {template_pattern(m, OPENING)}')" for _, m in TEMPLATES)
_JOINED = "array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ',')"
LICENSES = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s, {", ".join(f"{_places(x)} AS p{i}" for i, (x, _) in enumerate(PHRASES))} FROM t),
q AS (SELECT *, {" || ".join(f"p{i}" for i in range(len(PHRASES)))} AS every, [{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))}] AS base, [{_FOUND}] AS found FROM p)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word, {_JOINED.format("base")} AS base_labels, {_JOINED.format("(base || found)")} AS labels,
  CASE WHEN len(list_filter(found, lambda x: x IS NOT NULL)) > 0 THEN 1e0 WHEN len(every) > 0 THEN 0.5e0 WHEN {_OPENED} THEN 0.25e0 ELSE 0e0 END AS score FROM q"""

# crc32 of UTF-8, four bits at a time

_NIBBLES = []
for _v in range(16):
    for _ in range(4):
        _v = _v >> 1 ^ (0xEDB88320 if _v & 1 else 0)
    _NIBBLES.append(_v)
_CRC8 = (
    "xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, len({0})), lambda i: (strpos('0123456789ABCDEF', substr({0}, (CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::INT, 1)) - 1)::UBIGINT), "
    f"lambda a, b: xor(a >> 4, ({_NIBBLES}::UBIGINT[])[(xor(a & 15, b) + 1)::INT])), 4294967295::UBIGINT)"
)

# periodic runs: windows of 2, 4, 8 ... words named by their first place; a run of period q is where a window of q words or more comes again after q words, place by place

_LEVELS = 14
RUNS = rf"""
WITH c AS (SELECT doc_id, {_CRC8.format("hex(encode(doc_id::VARCHAR))")} AS h FROM (SELECT DISTINCT doc_id FROM documents)),
d AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents JOIN c USING (doc_id)),
e AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10)::BIGINT % len(w) END AS a, 3 + (h // 10)::BIGINT % 8 AS z FROM d),
x AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // z) END]) END AS w FROM e),
t AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM x),
l0 AS (SELECT doc_id, n, i, min(i) OVER (PARTITION BY doc_id, word) AS g FROM t),
{"".join(f"l{k} AS (SELECT a.doc_id, a.n, a.i, min(a.i) OVER (PARTITION BY a.doc_id, a.g, b.g) AS g FROM l{k - 1} a JOIN l{k - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {2 ** (k - 1)} WHERE a.n > {2 ** (k + 1)})," for k in range(1, _LEVELS))}
again AS ({" UNION ALL ".join(f"SELECT doc_id, i, {2**k} AS size, lead(i) OVER (PARTITION BY doc_id, g ORDER BY i) - i AS q FROM l{k}" for k in range(_LEVELS))}),
place AS (SELECT doc_id, i, size, q, i - row_number() OVER (PARTITION BY doc_id, size, q ORDER BY i) AS part FROM again WHERE q <= size AND q > size // 2),
stretch AS (SELECT doc_id, min(i) AS start, max(i) + size + q - min(i) AS length, q AS period FROM place GROUP BY doc_id, size, q, part),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM stretch WHERE length >= greatest(6, 4 * period)),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM t WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = t.doc_id AND gone.i = t.i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(said.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM x LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, start, length, period FROM runs WHERE place = 1) USING (doc_id)"""

# personal data: matches by place, then tests, context and overlaps by joins

_LUHN = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ascii(substr({0}, (len({0}) + 1 - i)::INT, 1)) - 48 ELSE (2 * (ascii(substr({0}, (len({0}) + 1 - i)::INT, 1)) - 48)) // 10 + (2 * (ascii(substr({0}, (len({0}) + 1 - i)::INT, 1)) - 48)) % 10 END)) % 10 = 0"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_ACCOUNT = "regexp_replace(m, ' ', '', 'g')"
_NUMBERED = f"list_transform(string_split(substr({_ACCOUNT}, 5) || substr({_ACCOUNT}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
_MOD97 = f"list_reduce([0::BIGINT] || {_NUMBERED}, lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"
_SIZE_OF = f"coalesce((MAP {IBAN_SIZES})[m[1:2]], 0)"
_SAID = "CASE kind " + " ".join(f"WHEN {i} THEN regexp_matches(near, '(?:^|[^a-z])(?:{r.words})(?:[^a-z]|$)')" for i, r in enumerate(PII_RULES.values())) + " END"
_PII_KINDS = "['email', 'ip', 'card', 'phone', 'card_part', 'iban', 'ssn', 'local', 'ip6'][kind + 1]"
PII = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, kind, s, e FROM (
  {_spans(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, 0)}
  UNION ALL SELECT * FROM ({_spans(1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0, 0)}) WHERE len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0
  UNION ALL SELECT * FROM ({_spans(2, r"[0-9](?:\x20?-?[0-9])+".replace(r"\x20?-?", "[ -]?"), 0, 0)}) WHERE len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN.format(_DIGITS)}
  UNION ALL SELECT * FROM ({_spans(3, r"\+[0-9][ ().0-9-]+[0-9]", 0, 0)}) WHERE len({_DIGITS}) BETWEEN 8 AND 15)),
told AS (
  SELECT * FROM ({_spans(4, "[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19}", 0, 0)}) WHERE m[1] IN ('3', '4', '5', '6') AND {_LUHN.format(_DIGITS)}
  UNION ALL SELECT doc_id, kind, s, s + len(m) AS e, m FROM (SELECT doc_id, kind, s, m[1:list_filter(range(1, len(m) + 1), lambda i: m[i] <> ' ')[{_SIZE_OF}]] AS m FROM ({_spans(5, "[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}", 0, 0)}) WHERE {_SIZE_OF} BETWEEN 1 AND len({_ACCOUNT})) WHERE {_MOD97}
  UNION ALL SELECT * FROM ({_spans(6, "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0, 0)}) WHERE NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')
  UNION ALL SELECT * FROM ({_spans(7, r"\(?[0-9]{3,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}", 0, 0)}) WHERE len({_DIGITS}) BETWEEN 9 AND 12
  UNION ALL {_spans(8, "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}", 0, 0)}),
more AS (SELECT doc_id, kind, s, e FROM told JOIN docs USING (doc_id) WHERE NOT regexp_matches(CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END || substr(text, e + 1, 1), '[0-9A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = told.doc_id AND b.s < told.e AND b.e > told.s)),
near AS (SELECT *, {_LOWER.format("substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' | ' || substr(text, e + 1, 20)")} AS near FROM (SELECT * FROM base UNION ALL SELECT * FROM more) JOIN docs USING (doc_id)),
scored AS (SELECT doc_id, kind, s, e, least(1, greatest(0, {[round(100 * (r.prior + r.checksum)) for r in PII_RULES.values()]}[kind + 1] + CASE WHEN {_SAID} THEN 30 ELSE 0 END - CASE WHEN regexp_matches(near, '(?:^|[^a-z])(?:{OTHER})(?:[^a-z]|$)') THEN 30 ELSE 0 END) / 100) AS score FROM near),
found AS (SELECT * FROM scored WHERE kind < 4 OR score >= 0.5),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS {k}" for i, k in enumerate(("n_email", "n_ip", "n_card", "n_phone")))}, count(*) FILTER (kind > 3) AS n_more,
  string_agg({_PII_KINDS} || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < 4) AS b, string_agg({_PII_KINDS} || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans, string_agg(printf('%.2f', score), ',' ORDER BY kind, s) AS scores FROM found GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce({k}, 0) AS {k}" for k in ("n_email", "n_ip", "n_card", "n_phone", "n_more"))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM docs LEFT JOIN a USING (doc_id)"""

# spelling variants: words that agree without one letter

SPELLING = rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY 1, 2),
x AS (SELECT w, c, hex(encode(doc_id || ':' || w)) AS x FROM g),
h AS (SELECT w, c, {_CRC8.format("x")} AS h FROM x),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING len(word) >= 5 AND sum(c) >= 3),
o AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.rest = v.word UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
ends AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""

ORACLES = {
    "op2_ngram_jaccard_join": NEAR.strip(),
    "op4_lm_scoring": LM.strip(),
    "op5_url_filters": URLS.strip(),
    "op6_secret_scans": SECRETS.strip(),
    "op7_license_scans": LICENSES.strip(),
    "op11_periodic_runs": RUNS.strip(),
    "op12_pii": PII.strip(),
    "op13_spelling_variants": SPELLING.strip(),
}
