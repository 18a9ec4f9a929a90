"""Windows over metrics, logs and spans together, inventories, quality counters and gates of observations and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.columns import SEVERITIES, rate, stable_id
from vigil.sources.otlp import METRIC_KINDS, SPAN_KINDS

QUANTILES = (0.5, 0.95, 0.99)


def union(metrics: DataFrame, logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Observations of the three signals in one table, `signal` telling which; columns of the others are null."""
    parts = [d.withColumn("signal", F.lit(s)) for s, d in (("metrics", metrics), ("logs", logs), ("spans", spans))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def window_ns(ts_ns: Column, seconds: int) -> Column:
    """Start of the tumbling window in nanoseconds of integer time."""
    size = seconds * 1_000_000_000
    return ts_ns - F.pmod(ts_ns, F.lit(size))


def utc_text(ns: Column) -> Column:
    """ISO-8601 text of nanoseconds, to the second."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def service_windows(seen: DataFrame, seconds: int) -> DataFrame:
    """Wide windows by (run, service, start) over all signals: counts, rates (0.0 on nothing) and statistics (null on nothing) of logs, spans and
    metrics. Observations without a time are dropped. One shuffle by the window; quantiles and distinct counts are of one window each."""
    o = seen.where(F.col("timestamp_ns").isNotNull()).withColumn("start_ns", window_ns(F.col("timestamp_ns"), seconds))
    log, span, metric = (F.col("signal") == s for s in ("logs", "spans", "metrics"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    only = lambda c, v: F.when(c, F.col(v))
    severities = [n(log & (F.col("severity") == s)).alias(f"log_{s.lower()}_count") for s in (*SEVERITIES, "UNSPECIFIED")]
    kinds = [n(span & (F.col("kind") == k)).alias(f"span_{k.lower()}_count") for k in SPAN_KINDS]
    types = [n(metric & (F.col("metric_type") == t)).alias(f"metric_{t.lower()}_count") for t in METRIC_KINDS.values()]
    w = o.groupBy("run_id", "service_name", "start_ns").agg(
        F.count_distinct("source_id").alias("source_event_count"), n(log).alias("log_count"), *severities, F.avg(only(log, "body_bytes")).alias("log_body_bytes_mean"), F.max(only(log, "body_bytes")).alias("log_body_bytes_max"),
        n(span).alias("span_count"), n(span & F.col("is_error")).alias("span_error_count"), F.avg("duration_ms").alias("span_duration_ms_mean"), F.min("duration_ms").alias("span_duration_ms_min"), F.max("duration_ms").alias("span_duration_ms_max"),
        F.percentile("duration_ms", F.array(*map(F.lit, QUANTILES))).alias("_p"), *kinds, F.count_distinct(only(span, "operation")).alias("span_unique_operation_count"), F.coalesce(F.sum("exceptions"), F.lit(0)).alias("span_exception_event_count"),
        F.count_distinct("metric_name").alias("metric_name_count"), n(metric).alias("metric_point_count"), *types, F.count("*").alias("telemetry_observation_count"),
    )
    for s in ("warn", "error", "fatal"):
        w = w.withColumn(f"log_{s}_rate", rate(F.col(f"log_{s}_count"), F.col("log_count")))
    w = w.withColumn("span_error_rate", rate(F.col("span_error_count"), F.col("span_count")))
    for i, q in enumerate(("p50", "p95", "p99")):
        w = w.withColumn(f"span_duration_ms_{q}", F.col("_p")[i])
    start = utc_text(F.col("start_ns"))
    return w.drop("_p").withColumn("window_id", stable_id("run_id", "service_name", start, F.lit(str(seconds)))).withColumn("window_start_utc", start)


def merged_windows(metrics: DataFrame, seconds: int) -> DataFrame:
    """Long windows by (run, service, start, name, unit, type) of merged points: counts and sums of histograms and summaries. A sum is known
    only if every point has one; the mean is the sum by the observations."""
    m = metrics.where(F.col("timestamp_ns").isNotNull()).withColumn("start_ns", window_ns(F.col("timestamp_ns"), seconds))
    w = m.groupBy("run_id", "service_name", "start_ns", "metric_name", "unit", "metric_type").agg(
        F.count("*").alias("metric_point_count"), F.count_distinct("series").alias("metric_series_count"), F.avg("numeric_value").alias("metric_value_mean"), F.count("aggregate_count").alias("_n"), F.coalesce(F.sum("aggregate_count"), F.lit(0)).alias("_count"),
        F.when(F.count("aggregate_sum") == F.count("aggregate_count"), F.sum("aggregate_sum")).alias("_sum"), F.min("aggregate_min").alias("histogram_min"), F.max("aggregate_max").alias("histogram_max"),
    )
    for kind, is_kind in (("histogram", F.col("metric_type").isin("Histogram", "ExponentialHistogram")), ("summary", F.col("metric_type") == "Summary")):
        w = w.withColumn(f"{kind}_datapoint_count", F.when(is_kind, F.col("_n")).otherwise(0)).withColumn(f"{kind}_observation_count", F.when(is_kind, F.col("_count")).otherwise(0))
        w = w.withColumn(f"{kind}_sum", F.when(is_kind, F.col("_sum"))).withColumn(f"{kind}_mean", F.when(is_kind, F.try_divide("_sum", F.when(F.col("_count") > 0, F.col("_count")))))
    return w.drop("_n", "_count", "_sum")


def metric_inventory(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, metric_name, unit, metric_type): points, and the services that have it in order, comma-joined. Without `by` runs are merged."""
    g = metrics.groupBy(*by, "metric_name", "unit", "metric_type").agg(F.count("*").alias("points"), F.array_sort(F.collect_set("service_name")).alias("_s"))
    return g.withColumn("services", F.array_join("_s", ",")).drop("_s")


def kind_counts(seen: DataFrame) -> DataFrame:
    """(signal, name, n): how many logs have a severity, spans a kind, metrics a type."""
    name = F.coalesce(F.when(F.col("signal") == "logs", F.col("severity")), F.when(F.col("signal") == "spans", F.col("kind")), F.col("metric_type"))
    return seen.groupBy("signal", name.alias("name")).agg(F.count("*").alias("n"))


def quality(seen: DataFrame, most_missing: float) -> DataFrame:
    """By signal and service: observations, missing times, non-finite numbers, invalid durations; and whether they pass: none non-finite, and at
    most `most_missing` of the times missing."""
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    bad = odd("numeric_value") | odd("aggregate_sum") | odd("aggregate_min") | odd("aggregate_max") | odd("duration_ms")
    q = seen.groupBy("signal", "service_name").agg(F.count("*").alias("n"), F.count_if(F.col("timestamp_ns").isNull()).alias("missing_time"), F.count_if(bad).alias("non_finite"), F.count_if(F.coalesce("invalid_duration", F.lit(False))).alias("invalid_durations"))
    share = rate(F.col("missing_time"), F.col("n"))
    return q.withColumn("missing_share", share).withColumn("passed", (F.col("non_finite") == 0) & (F.col("n") > 0) & (share <= most_missing))


def feature_gate(rows: DataFrame, counts: list[str], rates: list[str], durations: list[str], start: str, end: str) -> DataFrame:
    """One row: how many rows break each rule: window of no length, negative counts, rates outside [0, 1], negative durations, numbers that aren't finite."""
    some = lambda cs, f: reduce(Column.__or__, (F.coalesce(f(F.col(c)), F.lit(False)) for c in cs), F.lit(False))
    odd = some([*counts, *rates, *durations], lambda c: F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col(end) <= F.col(start)).alias("empty_window"), F.count_if(some(counts, lambda c: c < 0)).alias("negative_count"),
        F.count_if(some(rates, lambda c: (c < 0) | (c > 1))).alias("rate_outside"), F.count_if(some(durations, lambda c: c < 0)).alias("negative_duration"), F.count_if(odd).alias("not_finite"),
    )


def table_gate(rows: DataFrame, key: str, parts: list[str], filled: list[str]) -> DataFrame:
    """One row: rows, repeated keys, keys that aren't the hash of their parts, and rows with a missing value that must be there."""
    none = reduce(Column.__or__, (F.col(c).isNull() for c in filled))
    by_key = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.coalesce(F.col(key) != stable_id(*(F.col(p).cast("string") for p in parts)), F.lit(True))).alias("_w"), F.count_if(none).alias("_m"))
    return by_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"), F.coalesce(F.sum("_w"), F.lit(0)).alias("wrong_key"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing"))


def run_features(windows: DataFrame, score: str, ties: list[str], decided: Column, means: list[str], maxima: list[str], sums: list[str], k: int = 3) -> DataFrame:
    """By run: highest, mean, least and population deviation of the k highest scores, how many windows are decided anomalous and how many there
    are, and over the k windows the means, maxima and sums of features; a missing feature counts as 0.

    The k windows of a run come from a partial top-k before the shuffle, so a run of any length sends k rows for each task."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy(F.desc(score), *ties)
    top = windows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    a = top.groupBy("run_id").agg(
        F.max(score).alias("score_max"), F.avg(score).alias("score_mean_top"), F.min(score).alias("score_min_top"), F.stddev_pop(score).alias("score_std_top"),
        *(F.avg(z(c)).alias(f"{c}_top_mean") for c in means), *(F.max(z(c)).alias(f"{c}_top_max") for c in maxima), *(F.sum(z(c)).alias(f"{c}_top_sum") for c in sums),
    )
    whole = windows.groupBy("run_id").agg(F.count_if(decided).alias("exceed_count"), F.count("*").alias("eligible_window_count"))
    return a.join(whole, "run_id")


def ground_truth(rows: DataFrame, expected: DataFrame, normal: str = "normal") -> DataFrame:
    """Adds `role` to rows (scenario, service_name) against (scenario, services array): normal_negative, injected_positive, or
    propagation_ambiguous for a service that the fault doesn't hit itself; unknown_scenario where the catalog lacks it. The catalog is a row for each scenario."""
    j = rows.join(F.broadcast(expected), "scenario", "left")
    hit = F.array_contains("services", F.col("service_name"))
    role = F.when(F.col("scenario") == normal, "normal_negative").when(F.col("services").isNull(), "unknown_scenario").when(hit, "injected_positive").otherwise("propagation_ambiguous")
    return j.withColumn("role", role).drop("services")
