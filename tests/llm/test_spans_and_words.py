"""Periodic runs, personal data and spelling variants, against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic_runs as R
from lodestone.llm import pii as P
from lodestone.llm import spelling as W
from lodestone.llm.oracles import ORACLES
from lodestone.llm.queries import QUERIES
from tests.llm.helpers import EDGE_TEXTS, SPACED, UPPER, edge_docs

# periodic runs


def plain_edges(t):
    nss, far = [], []
    for i in range(len(t)):
        j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
        k = 0
        while j + k < len(t) and t[j + k] == t[i + k]:
            k += 1
        nss.append(j)
        far.append(k)
    return nss, far


def plain_runs(t, min_length=6, min_exponent=4):
    out = set()
    for q in range(1, len(t) // min_exponent + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(min_length, min_exponent * q) and not any(t[i : i + n - d] == t[i + d : i + n] for d in range(1, q)):
                out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@st.composite
def repetitive(draw):
    t = draw(st.lists(st.integers(0, 2), max_size=12))
    for _ in range(draw(st.integers(0, 4))):
        if t:
            a = draw(st.integers(0, len(t) - 1))
            t = t + t[a : a + draw(st.integers(1, 6))] * draw(st.integers(1, 5))
    return t[:70]


@settings(max_examples=400, deadline=None)
@given(repetitive())
def test_edges_and_runs(t):
    assert R.lyndon_edges(t) == plain_edges(t)
    for least, exponent in ((6, 4), (2, 2), (5, 3)):
        assert R.runs_of(t, least, exponent) == plain_runs(t, least, exponent)


class Counted(int):
    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    def __gt__(self, other):
        Counted.n += 1
        return int(self) > int(other)

    __hash__ = int.__hash__


def repeated_word(kind, n=4000):
    a, b = [0], [0, 1]
    if kind == "fibonacci":
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == "thue":
        while len(a) < n:
            a = a + [1 - x for x in a]
        return a
    return {"one": [0] * n, "last": [0] * n + [1], "nested": ((([0] * 5 + [1]) * 5 + [2]) * 5 + [3]) * 30, "down": ((([0] * 5 + [-1]) * 5 + [-2]) * 5 + [-3]) * 30, "blocks": ([0] * 50 + [1]) * 80, "random": [random.Random(3).randrange(2) for _ in range(n)]}[kind]


@pytest.mark.parametrize("kind", ["fibonacci", "thue", "one", "last", "nested", "down", "blocks", "random"])
def test_edges_take_linear_time(kind):
    t = repeated_word(kind)
    Counted.n = 0
    R.lyndon_edges([Counted(x) for x in t])
    assert Counted.n <= 4 * len(t)


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def noisy(rnd, n):
    """Words with stretches that repeat, words beyond eight and sixteen bytes, and odd spaces."""
    out = []
    while len(out) < n:
        piece = [rnd.choice(["a", "b", "longer_word", "longer_wore", "a_much_longer_word_x", "a_much_longer_word_y", "é", "x\x00", "x"]) for _ in range(rnd.randint(1, 5))]
        out += piece * rnd.choice([1, 1, 1, 4, 5, 9])
    return "".join(w + rnd.choice([" ", " ", " ", "\n", "  "]) for w in out[:n])


def test_texts_with_runs():
    rnd = random.Random(5)
    texts = [noisy(rnd, rnd.randint(0, 150)) for _ in range(200)] + EDGE_TEXTS
    n, runs, left = R.scan_column(pa.array(texts, pa.string()))
    for text, count, found, kept in zip(texts, n.tolist(), runs, left, strict=True):
        w = SPACED.findall(text or "")
        want = plain_runs(w)
        assert count == len(w) and [(x["start"], x["length"], x["period"]) for x in found] == want and kept == plain_collapsed(w, want)


def test_periodic_tails(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    got = dict(map(tuple, R.with_periodic_tail(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    changed = 0
    for i, text in rows:
        w, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
            changed += 1
        assert got[i].split() == w
    assert changed > 10


def test_run_digest(spark):
    rows = [(1, "a a a a a a b a b a b a b a b"), (2, "no run"), (3, None), (4, "x " * 6 + "y z " * 12)]
    got = {r["doc_id"]: r for r in R.run_digest(R.find_runs(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[1]["n_runs"], got[1]["start"], got[1]["length"], got[1]["period"], got[1]["exponent_milli"]) == (2, 0, 6, 1, 6000)
    assert got[1]["runs_sha256"] == hashlib.sha256(b"0,6,1\n5,10,2\n").hexdigest() and got[1]["collapsed_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert (got[4]["start"], got[4]["length"], got[4]["period"]) == (6, 24, 2)
    for k in (2, 3):
        assert got[k]["n_runs"] == 0 and got[k]["start"] is None and got[k]["exponent_milli"] is None and got[k]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def test_runs_edge_cases(spark):
    docs = edge_docs(spark)
    out = R.run_digest(R.find_runs(R.with_periodic_tail(docs)))
    assert out.count() == docs.count() and R.find_runs(docs.limit(0)).count() == 0


# personal data

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", P.emails),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", P.addresses),
    "card": (r"[0-9]([\x20-]?[0-9])+", P.cards),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", P.phones),
}


def plain_luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain_base(kind, text):
    for m in re.finditer(PLAIN[kind][0], text):
        n = len(re.sub("[^0-9]", "", m[0]))
        if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= n <= 19 and plain_luhn(m[0]) or kind == "phone" and 8 <= n <= 15:
            yield m.span()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("aZ9.@-_+ é", max_size=60), st.text("0123456789.", max_size=60), st.text("+0123 ().-", max_size=60)))
def test_base_spans(text):
    for kind, (_, find) in PLAIN.items():
        assert list(find(text)) == list(plain_base(kind, text))


def with_check_digit(n):
    return next(n + str(c) for c in range(10) if plain_luhn(n + str(c)))


def test_long_local_parts():
    for n in (63, 64, 65, 200, 5000):
        for text in ("a" * n + "@b.cd", " " + "a" * n + "@b.cd", "é" + "a" * n + "@b.c@d.e"):
            assert list(P.emails(text)) == list(plain_base("email", text))


def test_time_grows_with_the_text():
    start = time.time()
    for text in ("a" * 1_000_000, "a" * 1_000_000 + "@x", "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+1" * 500_000, "a@" * 500_000, "A1" * 500_000, "1234 " * 200_000):
        P.find_spans(text)
    assert time.time() - start < 60


IBAN = "DE89 3704 0044 0532 0130 00"
CARD, AMEX = with_check_digit("411111111111111"), with_check_digit("37828224631000")
METHOD = [
    (f"pay to {IBAN} NOW", "iban", IBAN),
    (f"pay to GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
    (f"{CARD} {CARD}", "card_part", CARD),
    (f"my card: {AMEX}", "card_part", AMEX),
    ("his SSN is 123-45-6789", "ssn", "123-45-6789"),
    ("call (212) 555-0199 today", "local", "(212) 555-0199"),
    ("host 2001:0db8:0000:0000:0000:ff00:0042:8329 up", "ip6", "2001:0db8:0000:0000:0000:ff00:0042:8329"),
]


@pytest.mark.parametrize("text, kind, found", METHOD)
def test_method_spans(text, kind, found):
    assert [text[s:e] for k, s, e, _ in P.find_spans(text) if k == kind][:1] == [found]


@pytest.mark.parametrize(
    "text", ["pay to DE89 3704 0044 0532 0130 01 NOW", "DE89370400440532013000X", "XX89370400440532013000", "the number 123-45-6789", "SSN 000-45-6789", "SSN 123-00-6789", "212 555 0199", "invoice (212) 555-0199 phone", f"x{CARD}x {CARD[:-1]}", "1234567890123456 1", "", "no data"]
)
def test_no_spans(text):
    assert [x for x in P.find_spans(text) if x[0] not in P.BASE] == []


def test_context_moves_the_score():
    scores = [P.find_spans(t)[0][3] for t in (f"credit card {CARD}", f"it is {CARD}", f"order {CARD}")]
    assert scores == [1.0, 0.7, 0.4]  # base spans stay whatever their score


def sql_on(name, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    rows = con.sql(ORACLES[name])
    return sorted(map(repr, ({c: r[i] for i, c in enumerate(rows.columns)} for r in rows.fetchall())))


def rows_of(df, columns=None):
    return sorted(map(repr, ({c: r[c] for c in columns or df.columns} for r in df.collect())))


def test_pii_equals_sql(spark):
    rnd = random.Random(8)
    bits = [t for t, _, _ in METHOD] + ["a.b+c@d.example.org", "10.0.0.256", "1.2.3.4.5.6.7.8", "+49 (30) 1234-5678", "host", "e-mail", "order no", "\n", "é", "isbn 978-3-16-148410-0", "1:2:3:4:5:6:7:8", "DE", "ÄÖ@ü", "-", "."]
    texts = [rnd.choice(["", " ", ", "]).join(rnd.choices(bits, k=rnd.randint(1, 6))) for _ in range(300)] + [None, ""]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    out = P.pii_digest(P.find_pii(spark.createDataFrame(table.to_pandas().assign(text=texts), "doc_id long, text string")))
    assert rows_of(out, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_more", "base_sha256", "spans", "scores"]) == sql_on("op12_pii", table)


def test_pii_edge_cases(spark):
    docs = edge_docs(spark)
    assert P.pii_digest(P.find_pii(docs)).count() == docs.count() and P.find_pii(docs.limit(0)).count() == 0


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    form, out = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append({"word": w, "form": form[w], "root": root, "n": n[w], "n_near": out[w], "form_n": n[form[w]] if form[w] else None})
    return sorted(map(repr, rows))


def plain_vocabulary(rows, slip=97, min_length=5, min_count=3):
    n = {}
    for key, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (text or "").translate(UPPER)):
            if slip and key is not None and (h := zlib.crc32(f"{key}:{w}".encode())) % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("seed, crowd, letters", [(1, 8, "abc"), (2, 0, "ab"), (3, 1, "aéb"), (4, 10**6, "ab")])
def test_variants_of_dense_words(spark, seed, crowd, letters):
    """Words so close that groups are cut again down to one letter (crowd 0), or never (crowd 10**6)."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choices(letters, k=rnd.randint(1, 7))): rnd.randint(1, 40) for _ in range(150)}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = W.spelling_variants(docs, min_length=1, min_count=2, crowd=crowd)
    assert rows_of(out, COLUMNS) == plain_variants(plain_vocabulary(rows, None, 1, 2))


def test_variants_with_slips_equal_sql(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghéÄÿX×", k=rnd.randint(4, 8))) for _ in range(120)]
    rows = [(i, rnd.choice([" ", ", ", "1"]).join(rnd.choices(words, k=40))) for i in range(150)] + [(900, None), (901, ""), (0, "x" * 3000 + " " + "x" * 3000 + " y" + "x" * 2999 + " " + "x" * 3000)]
    want = plain_vocabulary(rows)
    assert want != plain_vocabulary(rows, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(W.spelling_variants(docs, slip=97), COLUMNS)
    assert got == plain_variants(want)
    assert got == sql_on("op13_spelling_variants", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))


def test_forms_lead_to_their_root(spark):
    chain = ["abcdea", "abcdeb", "abcdfb", "abcgfb", "abhgfb", "aihgfb"]
    rows = [(i, " ".join([w] * 3**i)) for i, w in enumerate(chain, 1)]
    got = {r["word"]: (r["form"], r["root"]) for r in W.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: (f, chain[-1]) for w, f in zip(chain, [*chain[1:], None], strict=True)}


def test_variants_edge_cases(spark):
    docs = edge_docs(spark)
    assert rows_of(W.spelling_variants(docs, slip=97), COLUMNS) == plain_variants(plain_vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert W.spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        W.spelling_variants(docs, ratio=1)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_pii", "op13_spelling_variants"])
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    rows = con.sql(ORACLES[name])
    want = sorted(map(repr, ({c: r[rows.columns.index(c)] for c in sorted(rows.columns)} for r in rows.fetchall())))
    out = QUERIES[name](spark, data)
    assert rows_of(out, sorted(out.columns)) == want
