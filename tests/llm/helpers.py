from __future__ import annotations

import random
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: null, empty, blank, one long word, wide characters, ties
EDGE_TEXTS = [None, "", " \n\t", "x" * 5000, "日本 \U0001f600 é", "a a a a a a", "a a a a a a"]


def edge_docs(spark, extra=True):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id", None, None, None), (0, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that an operator may use for itself
    return df.selectExpr("*", "1 as k", "2 as size", "'z' as fp", "3.0 as score", "'x' as target") if extra else df


def words(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(rnd.paretovariate(0.7)) % vocabulary}" for _ in range(n))
