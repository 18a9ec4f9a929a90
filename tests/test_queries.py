"""Every query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from vigil.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def normal(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in SQL:
        cur = db.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = sorted(tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            for x, y in zip(a, b):
                assert x == y or abs(float(x) - float(y)) < 2e-5, (a, b)
