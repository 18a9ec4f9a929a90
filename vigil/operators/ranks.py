"""Places and running sums over an order, of whole tables or large groups, without a task that holds them: rows are dealt into ranges of the order,
each range is counted, and what stands before a range is added to what is counted inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.sources.tables import written


#: Rows of a table of groups up to which it is sent to all tasks.
MOST_GROUPS = 200_000


def by_group(groups: DataFrame, name: str) -> DataFrame:
    """A table of one row a group, written, to be joined to the groups' rows: sent to all tasks unless it is large, so that a few large groups aren't each
    sorted in one task. (Adaptive execution sends no table that fills but a few partitions.)"""
    laid = written(groups, name)
    return F.broadcast(laid) if laid.count() <= MOST_GROUPS else laid


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys of the same names, of which a null meets a null; the left side's keys stay."""
    named = right.select(*(F.col(f"`{k}`").alias(f"_right_{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in right.columns if c not in keys))
    on = [left[f"`{k}`"].eqNullSafe(named[f"_right_{i}"]) for i, k in enumerate(keys)]
    return left.join(named, on, how).drop(*(f"_right_{i}" for i in range(len(keys))))


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _before(ranges: DataFrame, sums: list[str], by: list[str]) -> DataFrame:
    """Adds what stands before each range of a group, and the group's total: at most a row for each range and group. Without groups, that is a row for each partition, summed by the driver."""
    if by:
        w = Window.partitionBy(*by).orderBy("_range")
        whole = Window.partitionBy(*by)
        return ranges.select(*by, "_range", *(c for c in ranges.columns if c not in (*by, "_range", *sums)), *((F.sum(s).over(w) - F.col(s)).alias(f"_{s}_before") for s in sums), *(F.sum(s).over(whole).alias(f"_{s}_all") for s in sums))
    rows = sorted(ranges.collect(), key=lambda r: r["_range"])
    done, out = dict.fromkeys(sums, 0), []
    total = {s: sum(r[s] or 0 for r in rows) for s in sums}
    rest = [c for c in ranges.columns if c not in ("_range", *sums)]
    for r in rows:
        out.append((r["_range"], *(r[c] for c in rest), *done.values(), *total.values()))
        done = {s: n + (r[s] or 0) for s, n in done.items()}
    kinds = dict(ranges.dtypes)
    schema = ", ".join([f"_range {kinds['_range']}", *(f"{c} {kinds[c]}" for c in rest), *(f"_{s}_before {kinds[s]}" for s in sums), *(f"_{s}_all {kinds[s]}" for s in sums)])
    return F.broadcast(ranges.sparkSession.createDataFrame(out, schema))


def _joined(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    return join_null_safe(rows, ranges, [*by, "_range"]) if by else rows.join(ranges, "_range")


def placed(rows: DataFrame, order: list, by: list[str] = [], name: str = "place") -> DataFrame:  # noqa: B006
    """Adds the place of each row, from 1, in an order within its group. Null keys are a group, null orders come first, equal rows are told apart by where they were
    read, so that many of them don't meet in one range. One shuffle by ranges, written once, since a range is another one when it is computed again."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = _columns(order)
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *by, *o, "_row").sortWithinPartitions(*by, *o, "_row").drop("_row")
    laid = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    ranges = _before(laid.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), ["_n"], by)
    return _joined(laid, ranges, by).withColumn(name, F.col("__n_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_range", "_first", "__n_before", "__n_all")


def running(rows: DataFrame, order: list, sums: dict[str, Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds, for each name in `sums`, the sum up to and with a row (and those equal to it in the order) within its group, and `<name>_all`, the group's. Rows should be distinct in the
    order, as after an aggregate: equal ones meet in one range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = _columns(order)
    valued = rows.withColumns({f"_s_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()})
    laid = written(valued.repartitionByRange(n, *by, *o).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = _before(laid.groupBy(*by, "_range").agg(*(F.sum(f"_s_{k}").alias(k) for k in sums)), list(sums), by)
    inside = Window.partitionBy(*by, "_range").orderBy(*o)
    met = laid.withColumns({f"_s_{k}": F.sum(f"_s_{k}").over(inside) for k in sums})
    out = _joined(met, ranges, by).withColumns({k: F.col(f"_{k}_before") + F.col(f"_s_{k}") for k in sums} | {f"{k}_all": F.col(f"_{k}_all") for k in sums})
    return out.drop("_range", *(f"_{k}_{x}" for k in sums for x in ("before", "all")), *(f"_s_{k}" for k in sums))
