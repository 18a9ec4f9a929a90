"""Places, running sums and quantiles against plain Python, with null keys, ties and a group that holds most rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import anomaly, windows
from vigil.operators.ranks import placed, running


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, *map(float, range(40))])) for i in range(3000)] + [(9000, "alone", 1.0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(5).cache()


def test_places(table, rows):
    for by in ([], ["k"]):
        got = placed(table, ["v", F.desc("id")], by).collect()
        groups = defaultdict(list)
        for i, k, v in rows:
            groups[k if by else 0].append((v is not None, v or 0.0, -i))
        want = {-x[2]: p for g in groups.values() for p, x in enumerate(sorted(g), 1)}
        assert {r.id: r.place for r in got} == want


def test_places_of_equal_rows(spark):
    t = spark.createDataFrame([("x",)] * 500 + [("y",)] * 3, "k string")
    got = placed(t, [F.lit(1)], ["k"]).groupBy("k").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {"x": list(range(1, 501)), "y": [1, 2, 3]}
    assert placed(t.limit(0), ["k"]).count() == 0


def test_running_sums(table, rows):
    counts = table.groupBy("k", "v").agg(F.count("*").alias("c"))
    got = running(counts, ["v"], {"upto": F.col("c")}, ["k"]).collect()
    c = Counter((k, v) for _, k, v in rows)
    less = lambda x, y: (x is not None, x or 0.0) <= (y is not None, y or 0.0)
    for r in got:
        assert r.upto == sum(n for (k, v), n in c.items() if k == r.k and less(v, r.v))
        assert r.upto_all == sum(n for (k, _), n in c.items() if k == r.k)
    assert len(got) == len(c)


@pytest.mark.parametrize("n", [2000, 20_000])
def test_no_range_holds_a_large_group(spark, n):
    """The largest range of the written table, when one group has nearly all rows."""
    t = spark.range(n).select((F.when(F.col("id") < 10, "b").otherwise("a")).alias("k"), F.xxhash64("id").alias("h"))
    laid = t.repartitionByRange(16, "k", "h").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert laid < 2.5 * n / 16


def test_areas_of_the_whole_table(spark, rows):
    known = [(i, v, int(i % 3 == 0)) for i, _, v in rows if v is not None]
    got = anomaly.binary_metrics(spark.createDataFrame(known, "id long, v double, t int"), "t", "v", 20.0).first()
    pos, neg = [v for _, v, t in known if t], [v for _, v, t in known if not t]
    u = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert abs(got.roc_auc - u / len(pos) / len(neg)) < 1e-6
    ap = sum(len([1 for _, w, t in known if t and w == v]) * len([1 for p in pos if p >= v]) / len([1 for _, w, _ in known if w >= v]) for v in {v for _, v, _ in known}) / len(pos)
    assert abs(got.average_precision - ap) < 1e-6


def test_null_groups_keep_their_baseline(table, rows):
    got = {r.k: r for r in anomaly.robust_baseline(table, ["k"], "v").collect()}
    parts = {r.k: r for r in windows.distribution(table, ["k"], "v").collect()}
    for k in {k for _, k, _ in rows}:
        x = np.array([v for _, g, v in rows if g == k and v is not None])
        assert abs(got[k].center - np.median(x)) < 1e-9 and got[k].n == len(x)
        mad = 1.4826 * np.median(np.abs(x - np.median(x)))
        assert abs(got[k].scale - (mad or 1.0)) < 1e-9
        assert abs(parts[k].p95 - np.quantile(x, 0.95)) < 1e-6


def test_a_few_large_groups_meet_their_quantiles_where_they_are(spark):
    """A table of a few groups is sent to the rows, even where Spark wouldn't: rows of a group are never sorted together in a task."""
    from vigil.operators import anomaly

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
        found = anomaly.quantiles(rows, ["g"], "v", (0.5,))
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        assert {r.g: (r.n, r.q0) for r in found.collect()} == {None: (334, 499.5), 1: (333, 499.0), 2: (333, 500.0)}
        apart = {r.g: (r.n, r.center) for r in anomaly.robust_baseline(rows, ["g"], "v").collect()}
        assert apart == {None: (334, 499.5), 1: (333, 499.0), 2: (333, 500.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
