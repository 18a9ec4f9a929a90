"""Event-time tumbling windows with exact statistics, duplicates, quality counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators import anomaly
from vigil.operators.ranks import join_null_safe
from vigil.functions.columns import rate, stable_id, window_start


def metric_windows(obs: DataFrame, seconds: int = 3600) -> DataFrame:
    """Long windows by (run, service, start, metric): counts, population deviation, exact percentiles, first and last value."""
    o = obs.withColumn("start_us", window_start(F.col("ts_us"), seconds))
    order = F.struct("ts_us", "series", "event_id")
    p = F.percentile("numeric_value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    w = o.groupBy("run_id", "service_name", "start_us", "metric_name").agg(
        F.count("*").alias("point_count"), F.count_distinct("series").alias("series_count"), F.avg("numeric_value").alias("mean"), F.stddev_pop("numeric_value").alias("std"),
        F.min("numeric_value").alias("min"), F.max("numeric_value").alias("max"), p.alias("p"), F.min_by("numeric_value", order).alias("first"), F.max_by("numeric_value", order).alias("last"),
    )
    window_id = stable_id("run_id", "service_name", F.col("start_us").cast("string"), F.lit(str(seconds)), "metric_name")
    return w.select(window_id.alias("window_id"), "run_id", "service_name", "start_us", (F.col("start_us") + seconds * 1_000_000).alias("end_us"), "metric_name", "point_count", "series_count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), "first", "last")


def service_windows(obs: DataFrame, error_metric: str, seconds: int = 3600) -> DataFrame:
    """Wide windows by (run, service, start): volumes and rates over all signals; 0 where a signal is absent, null statistics."""
    o = obs.withColumn("start_us", window_start(F.col("ts_us"), seconds))
    bad = F.count_if(F.col("metric_name") == error_metric)
    w = o.groupBy("run_id", "service_name", "start_us").agg(F.count("*").alias("observation_count"), F.count_distinct("event_id").alias("source_event_count"), F.count_distinct("metric_name").alias("metric_name_count"), bad.alias("error_count"), F.max(F.when(F.col("metric_name") == error_metric, F.col("numeric_value"))).alias("error_value_max"))
    return w.withColumn("error_rate", F.round(rate(F.col("error_count"), F.col("observation_count")), 6)).withColumn("window_id", stable_id("run_id", "service_name", F.col("start_us").cast("string"), F.lit(str(seconds))))


def first_of_each(rows: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """The first row of each key, with whether its repetitions carry another payload (an error to the caller)."""
    digest = stable_id(*(F.col(c).cast("string") for c in payload))
    hashed = rows.withColumn("_h", digest)
    clash = hashed.groupBy(key).agg((F.count_distinct("_h") > 1).alias("conflict"), F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("_x"))
    return clash.select(*(F.col(f"_x.{c}").alias(c) for c in rows.columns), "conflict")


def quality_counters(obs: DataFrame) -> DataFrame:
    """By service: rows, missing times, missing and non-finite values, shares."""
    v = F.col("numeric_value")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    q = obs.groupBy("service_name").agg(F.count("*").alias("n"), F.count_if(F.col("ts_us").isNull()).alias("missing_time"), F.count_if(v.isNull()).alias("missing_value"), F.count_if(odd).alias("non_finite"), F.count_if(v < 0).alias("negative"))
    return q.withColumn("missing_time_rate", rate(F.col("missing_time"), F.col("n")))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median, p95, p99, min, max; a group without values has none."""
    p = anomaly.quantiles(rows, by, value, (0.5, 0.95, 0.99)).drop("n")
    d = rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return join_null_safe(d, p, by, "left").select(*by, "n", "mean", "min", "max", *(F.round(f"q{i}", 6).alias(k) for i, k in enumerate(("p50", "p95", "p99"))))


def top_windows(scored: DataFrame, by: list[str], score: str, ties: list[str], k: int = 3) -> DataFrame:
    """Aggregate of the k highest-scoring rows of each group, and the group's size; k is the group's size if that is less."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    a = top.groupBy(*by).agg(F.count("*").alias("used"), F.max(score).alias("score_max"), F.min(score).alias("score_min"), F.round(F.avg(score), 6).alias("score_mean"), F.round(F.stddev_pop(score), 6).alias("score_std"))
    return a.join(scored.groupBy(*by).agg(F.count("*").alias("eligible")), by)
