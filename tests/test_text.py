from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import ids as I
from lodestone.functions import text as X
from lodestone.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def py_keywords(s):
    return list(dict.fromkeys(w for w in re.findall(r"\b[a-z]{3,}\b", s.lower()) if w not in X.STOPWORDS))


def py_entities(s):
    return list(dict.fromkeys(re.findall(r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b", s)))


def test_extraction_agrees_with_python(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", X.keywords(F.col("text")).alias("k"), X.entities(F.col("text")).alias("e")).collect()
    for r in rows:
        assert r.k == py_keywords(r.text)
        assert r.e == py_entities(r.text)


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aAbZz éÉ09_-\n.the", max_size=60))
def test_extraction_of_any_text(spark, s):
    r = spark.createDataFrame([(s,)], "v string").select(X.keywords(F.col("v")), X.entities(F.col("v"))).first()
    assert (r[0], r[1]) == (py_keywords(s), py_entities(s))


def test_tags(spark):
    df = spark.createDataFrame([(["Ab", "Cd"], ["ab", "e", "f", "g", "h"]), ([], [])], "e array<string>, k array<string>")
    assert [r[0] for r in df.select(X.tags(F.col("e"), F.col("k"))).collect()] == [["ab", "cd", "e", "f", "g"], None]


@pytest.mark.parametrize("raw,want", [("  Deploy Notes! ", "deploynotes"), ("../x", "x"), ("", "notes"), (None, "notes"), ("A" * 70, "a" * 64), ("a_b-c", "a_b-c")])
def test_category(spark, raw, want):
    assert one(spark, X.category, raw) == want


def test_mirror_line_and_snippet(spark):
    assert one(spark, X.mirror_line, "a\r\nb\rc\nd <!-- x") == "- a b c d <!- - x"
    assert one(spark, X.snippet, "x" * 160) == "x" * 160
    assert one(spark, X.snippet, "x" * 161) == "x" * 160 + "…"
    assert one(spark, X.one_line, "# a\nb") == " # a b"


def test_tokens(spark):
    assert one(spark, X.tokens, "Élan foo_bar, x1 日本") == ["elan", "foo", "bar", "x1", "日本"]
    assert one(spark, X.tokens, None) == []


def test_entry_id(spark):
    import hashlib

    df = spark.createDataFrame([("aaa", 1)], "c string, s long").select(I.entry_id(F.col("c"), F.col("s")))
    assert df.first()[0] == hashlib.sha256(b"aaa:1").hexdigest()


def test_encryption(spark):
    key, other = bytes(range(32)), bytes(32)
    df = spark.createDataFrame([(b"hello",)], "p binary")
    enc = df.select("p", I.encrypt(F.col("p"), F.lit(key), F.lit(b"aad")).alias("c")).cache()
    raw = bytes(enc.first()["c"])
    assert raw[:2] == b"\x01\x00" and len(raw) == 2 + 12 + 5 + 16
    got = enc.select(*[I.decrypt(F.col("c"), F.lit(k), F.lit(a)) for k, a in ((key, b"aad"), (other, b"aad"), (key, b"no"))]).first()
    assert (bytes(got[0]), got[1], got[2]) == (b"hello", None, None)
    assert enc.select(I.decrypt(F.concat(F.lit(b"\x02\x00"), F.substring("c", 3, 99)), F.lit(key), F.lit(b"aad"))).first()[0] is None


def test_blinding_is_stable_and_hides(spark):
    a, b = I.blind_project(bytes(32), "p"), I.blind_project(bytes(32), "q")
    assert a == I.blind_project(bytes(32), "p") != b and re.fullmatch("[0-9a-f]{64}", a)
    # RFC 5869 test case 3 (no salt, no info)
    assert I.hkdf(b"\x0b" * 22, b"", 42).hex().startswith("8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d")


@given(st.lists(st.binary(max_size=20), max_size=5))
def test_unframe_inverts_framing(parts):
    data = b"".join(len(p).to_bytes(4, "big") + p for p in parts)
    assert I.unframe(data) == parts


def test_framed_column(spark):
    assert bytes(one(spark, I.framed, b"abc", "binary")) == b"\x00\x00\x00\x03abc"
    with pytest.raises(ValueError):
        I.unframe(b"\x00\x00\x00\x09ab")


def test_vectors(spark):
    packed = V.pack_embedding([1.0, -2.0], 2)
    got = spark.createDataFrame([(packed,), (b"abc",), (None,)], "b binary").select(V.unpack_embedding("b")).collect()
    assert [g[0] for g in got] == [[1.0, -2.0], None, None]
    with pytest.raises(ValueError):
        V.pack_embedding([1.0], 2)
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.dot(F.col("a"), F.col("b"))).collect()] == [7.0, None]
    assert df.select(V.normalized(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])
    long = spark.createDataFrame([([1.0] * 300,)], "a array<float>")
    assert long.select(V.dot_literal(F.col("a"), [1.0] * 300)).first()[0] == 300.0


def test_embedding_udf(spark):
    e = V.embed_udf(lambda: V.hashing_embedder(16))
    rows = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "t string").select(e("t")).collect()
    assert rows[0] == rows[1] and sum(x * x for x in rows[0][0]) == pytest.approx(1, abs=1e-5)
    assert set(rows[2][0]) == {0.0}


def test_mean_pool():
    import numpy as np

    h = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]])
    assert np.allclose(V.mean_pool(h, np.array([[1, 1, 0]])), [[2**-0.5, 2**-0.5]])
    with pytest.raises(ValueError):
        V.mean_pool(np.zeros(3), np.zeros(3))
