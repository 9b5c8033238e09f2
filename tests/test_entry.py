from __future__ import annotations

import re
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"lodestone(\.| import )llm", p.read_text()), p


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert len([n for n in names if not n.startswith("op")]) >= 60
    assert set(entry.oracle_sql()) <= names
    if Path(entry.SMOKE_DIR).exists():
        df = entry.entry(spark)
        assert df.columns == ["id", "score", "tier"] and df.count() > 0


CORE = ["list_project", "stats", "tag_filter", "r0", "r1", "r2", "r2_or", "r2_phrase", "r2_not", "r3", "r3_access", "knn_project", "conflicts", "all_pairs_dup", "keywords", "mirror_lines", "bfs_2", "traverse_edges", "graph_expand", "oplog_fold", "oplog_conflicts", "oplog_dedup", "backfill", "relay_page", "relay_append", "drain_counts", "snapshot", "store_snapshot", "entities", "mark_pushed", "rate_window"]


@pytest.mark.parametrize("name", CORE)
def test_query_agrees_with_its_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cell = lambda v: "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    got, want = entry.queries()[name](spark, data).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(tuple(map(cell, r)) for r in x[cols].itertuples(index=False)) for x in (got, want)]
    assert rows[0] == rows[1]
