"""Every query with SQL beside it gives the same rows in both engines."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from nimbusframe.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def normal(v):
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*cols).collect())
    if name in catalogue.ORACLE_SQL:
        names = ",".join(f'"{c}"' for c in cols)
        assert got == sorted(tuple(map(normal, r)) for r in duck.sql(f"select {names} from ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
