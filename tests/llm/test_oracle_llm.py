"""Queries with SQL give DuckDB's rows on the driver's small tables."""

from pathlib import Path

import pytest

from quarry.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = QUERIES[name](spark, str(DATA)), con.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([str(r[c]) for c in columns] for r in got.collect()) == sorted([str(r[k]) for k in at] for r in want.fetchall())
