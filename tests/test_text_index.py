from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.operators.text_index import TextIndex
from lodestone.sources import tables

QUERIES = ["that the", "shan OR est", '"of the"', "thea* and", "the NOT ronan", "^the OR est", "NEAR(the of, 3)", 'NEAR("of the" that, 8) OR est', '"the th"*', "a-b", "nowhere"]


@pytest.fixture(scope="module")
def indexed(spark, data, tmp_path_factory):
    atoms = tables.atoms(spark, data).select("id", "project_id", "content", "created_at", "row_seq", "invalidated", "session_id", "tags").cache()
    index = TextIndex(spark, str(tmp_path_factory.mktemp("text")))
    index.add(atoms.where("row_seq % 3 > 0"))
    index.add(atoms)
    return atoms, index


@pytest.mark.parametrize("query", QUERIES)
def test_scores_are_those_of_a_scan(indexed, query):
    atoms, index = indexed
    rows = retrieval.candidates(atoms, "src1")
    read = lambda df: {r.id: round(r.score, 9) for r in df.select("id", "score").collect()}
    assert read(index.scores(rows, query, "src1")) == read(retrieval.bm25_scores(rows, query))


def test_statistics_are_those_of_the_candidates(indexed):
    atoms, index = indexed
    rows = retrieval.candidates(atoms, "src1", include_invalidated=True).where("row_seq % 3 > 0")
    best = [[(r.id, round(r.score, 9)) for r in df.collect()] for df in (index.search(rows, "the, est?", "src1", 5, strict=False), retrieval.bm25(rows, "the, est?", 5, strict=False))]
    assert best[0] == best[1] and len(best[0]) > 0


@pytest.mark.parametrize("query", QUERIES)
def test_records_that_are_not_indexed_are_found(spark, data, tmp_path_factory, query, partly={}):
    """A third of the records is missing from the index: scores are those of a scan all the same."""
    atoms = tables.atoms(spark, data).select("id", "project_id", "content", "created_at", "row_seq", "invalidated", "session_id", "tags")
    if not partly:
        partly["index"] = TextIndex(spark, str(tmp_path_factory.mktemp("partly")))
        partly["index"].add(atoms.where("row_seq % 3 > 0"))
    rows = retrieval.candidates(atoms, "src1")
    read = lambda df: {r.id: round(r.score, 9) for r in df.select("id", "score").collect()}
    assert read(partly["index"].scores(rows, query, "src1")) == read(retrieval.bm25_scores(rows, query))


def test_postings_are_found_by_folder_and_term(spark, indexed, capsys):
    _, index = indexed
    rows = index._table("lengths", "project_id string, id string, length int").select("id", F.lit("").alias("content"), F.lit("").alias("created_at"), F.lit(0).alias("row_seq"))
    index.scores(rows, "est", "src1").explain("formatted")
    plan = capsys.readouterr().out
    assert "StartsWith" not in plan and "EqualTo(term,est)" in plan and "(project_id" in plan.split("PartitionFilters")[1]


def test_empty_and_odd_records(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "p", "x y x"), ("b", "p", None), ("c", "p", ""), (None, "p", "x"), ("d", None, "x")], "id string, project_id string, content string")
    index.add(rows.limit(0))
    mine = rows.where("project_id = 'p' and id is not null")
    assert [r.id for r in index.scores(mine, "x", "p").collect()] == ["a"]  # nothing is indexed yet
    index.add(rows)
    index.add(rows)
    found, scan = index.scores(mine, "x", "p").collect(), retrieval.bm25_scores(mine, "x").collect()
    assert [(r.id, r.score) for r in found] == [(r.id, r.score) for r in scan] and len(found) == 1


def test_occurrences_are_not_shuffled(spark, monkeypatch):
    """Postings are made where a record stands, a few words at a time."""
    from lodestone.operators import text_index

    split = spark.createDataFrame([("p", f"r{i}", ["a", "b", "a"] if i % 3 else []) for i in range(20)] + [("p", "none", None)], "project_id string, id string, t array<string>")
    made = text_index.postings(split.where("t is not null"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {(f"r{i}", w): at for i in range(20) if i % 3 for w, at in (("a", [0, 2]), ("b", [1]))}
    assert {(r.id, r.term): r.positions for r in made.collect()} == want
    batch = split.where("t is not null").toArrow().to_batches()[0]
    monkeypatch.setattr(text_index, "AT_ONCE", 3)
    assert len(list(text_index._placed([batch]))) > 1
