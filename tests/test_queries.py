"""Every query with SQL gives the rows that DuckDB gives on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from herdplan.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, str):
        return v
    return "nan" if math.isnan(float(v)) else f"{round(float(v), 8) + 0.0:.8f}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in ORACLE_SQL:
        q = duck.sql(ORACLE_SQL[name])
        names = q.columns
        assert sorted(names) == columns
        want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in q.fetchall())
        assert rows == want
