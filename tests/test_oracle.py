"""Every query with SQL gives DuckDB's rows on the driver's small tables."""

from pathlib import Path

import pytest

from quarry.plans import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    rows = got.collect()
    assert rows
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[k]) for k in at] for r in want.fetchall())
