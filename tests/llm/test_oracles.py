"""Operators with SQL: the same rows in DuckDB."""

import duckdb
import pytest

from vigil.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    got = queries.queries()[name](spark, DIR)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    assert [x[0] for x in cur.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())


def test_components_of_a_hub(spark):
    """A star of many leaves, listed from either side, and chains into it."""
    from vigil.llm.common import Workspace, components

    edges = [(i, 7) if i % 2 else (7, i) for i in range(8, 3000)] + [(2, 2000), (3001, 2999), (3002, 3001)]
    got = {r.id: r.component for r in components(Workspace(spark), spark.createDataFrame(edges, "a long, b long"), "hub").collect()}
    assert got == {i: 2 for i in {x for e in edges for x in e}}
