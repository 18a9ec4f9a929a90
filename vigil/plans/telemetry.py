"""Queries over OTLP lines of three signals, which are written out of events, and the same as DuckDB SQL over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import signals
from vigil.plans.catalog import query
from vigil.sources import otlp
from vigil.sources.tables import table

#: Rules by which events stand for telemetry (the same in SQL and in Spark): by event_id % 3 a metric point, a log or a span; services of some
#: users are blank; kinds, severities, unset times, ends before starts and missing sums by further remainders.
SEEN_SQL = """e AS (SELECT *, 'run-' || strftime(ts, '%Y%m%d') AS run_id, CASE WHEN user_id % 23 = 0 THEN '__unknown__' ELSE 'svc-' || (user_id % 10) END AS service_name, epoch_us(ts) * 1000 AS ns, event_id % 5 AS k5, event_id % 7 AS k7, event_id % 3 AS k3 FROM events),
m AS (SELECT event_id, run_id, service_name, ns AS timestamp_ns, event_type AS metric_name, '1' AS unit, ['Gauge','Sum','Histogram','ExponentialHistogram','Summary'][(k5 + 1)::INT] AS metric_type, user_id AS series,
 CASE k5 WHEN 0 THEN value WHEN 1 THEN floor(value)::DOUBLE END AS numeric_value, CASE WHEN k5 >= 2 THEN k7 END AS aggregate_count, CASE WHEN k5 = 4 OR (k5 >= 2 AND event_id % 11 <> 0) THEN value END AS aggregate_sum,
 CASE WHEN k5 IN (2, 3) THEN value - 1 END AS aggregate_min, CASE WHEN k5 IN (2, 3) THEN value + 1 END AS aggregate_max FROM e WHERE k3 = 0),
l AS (SELECT event_id, run_id, service_name, ns AS timestamp_ns, CASE WHEN event_id % 27 BETWEEN 1 AND 24 THEN ['TRACE','DEBUG','INFO','WARN','ERROR','FATAL'][((event_id % 27 - 1) // 4 + 1)::INT] ELSE 'UNSPECIFIED' END AS severity, strlen(event_type || ' é ' || props) AS body_bytes FROM e WHERE k3 = 1),
s AS (SELECT event_id, run_id, service_name, ns AS timestamp_ns, event_type AS operation, CASE WHEN k7 = 6 THEN 'UNSPECIFIED' ELSE ['UNSPECIFIED','INTERNAL','SERVER','CLIENT','PRODUCER','CONSUMER'][(k7 + 1)::INT] END AS kind, event_type = 'error' AS is_error,
 CASE WHEN event_id % 13 <> 0 THEN (floor(value * 1000)::BIGINT * 1000) / 1e6 END AS duration_ms, k5 AS exceptions, event_id % 13 = 0 AS invalid_duration FROM e WHERE k3 = 2),
o AS (SELECT 'metrics' AS signal, * FROM m UNION ALL BY NAME SELECT 'logs' AS signal, * FROM l UNION ALL BY NAME SELECT 'spans' AS signal, * FROM s)"""


def lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as OTLP JSON lines of metrics, logs and spans, each with its event id in an envelope."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    e = table(spark, d, "events").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    for k in (3, 5, 7):
        e = e.withColumn(f"k{k}", F.col("event_id") % k)
    service = F.when(F.col("user_id") % 23 == 0, "  ").otherwise(F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")))
    run = F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd"))
    # the first service name is overruled by the last
    resource = F.struct(F.array(text("service.name", F.lit("old")), text("run.id", run), text("service.name", service)).alias("attributes"))
    ns, v, k5 = F.col("ns").cast("string"), F.col("value"), F.col("k5")
    merged = F.struct(
        F.array(text("series", F.col("user_id").cast("string"))).alias("attributes"), ns.alias("timeUnixNano"), F.when(k5 == 0, v).alias("asDouble"), F.when(k5 == 1, F.floor(v).cast("string")).alias("asInt"), F.when(k5 >= 2, F.col("k7").cast("string")).alias("count"),
        F.when((k5 == 4) | ((k5 >= 2) & (F.col("event_id") % 11 != 0)), v).alias("sum"), F.when(k5.isin(2, 3), v - 1).alias("min"), F.when(k5.isin(2, 3), v + 1).alias("max"),
    )
    points = F.struct(F.array(merged).alias("dataPoints"))
    metric = F.struct(F.col("event_type").alias("name"), F.lit("1").alias("unit"), *(F.when(k5 == i, points).alias(f) for i, f in enumerate(otlp.METRIC_KINDS)))
    unset = F.col("event_id") % 4 == 0
    log = F.struct(F.when(unset, "0").otherwise(ns).alias("timeUnixNano"), F.when(unset, ns).alias("observedTimeUnixNano"), (F.col("event_id") % 27).cast("string").alias("severityNumber"), F.struct(F.concat("event_type", F.lit(" é "), "props").alias("stringValue")).alias("body"))
    length = F.when(F.col("event_id") % 13 == 0, F.lit(-1000).cast("long")).otherwise(F.floor(v * 1000).cast("long") * 1000)
    span = F.struct(F.col("event_type").alias("name"), F.col("k7").cast("string").alias("kind"), ns.alias("startTimeUnixNano"), (F.col("ns") + length).cast("string").alias("endTimeUnixNano"), F.struct(F.when(F.col("event_type") == "error", "2").otherwise("0").alias("code")).alias("status"), F.transform(F.array_repeat(F.lit("exception"), k5.cast("int")), lambda x: F.struct(x.alias("name"))).alias("events"))

    def written(k: int, root: str, scope: str, inner: str, x) -> DataFrame:
        body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(x).alias(inner))).alias(scope))).alias(root))
        return e.where(F.col("k3") == k).select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), body.alias("payload"))).alias("line"))

    return written(0, "resourceMetrics", "scopeMetrics", "metrics", metric), written(1, "resourceLogs", "scopeLogs", "logRecords", log), written(2, "resourceSpans", "scopeSpans", "spans", span)


def parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m, l, s = lines(spark, d)  # noqa: E741
    return otlp.metric_observations(m), otlp.log_observations(l), otlp.span_observations(s)


def seen(spark: SparkSession, d: str) -> DataFrame:
    return signals.union(*parsed(spark, d))


R = lambda names, kind="round({0}, 6)": ", ".join(f"{kind.format(n)} AS {n}" for n in names)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


_FLOATS = ("log_body_bytes_mean", "log_warn_rate", "log_error_rate", "log_fatal_rate", "span_error_rate", "span_duration_ms_mean", "span_duration_ms_p50", "span_duration_ms_p95", "span_duration_ms_p99")
_SERVICE_SQL = f"""{SEEN_SQL}, w AS (SELECT run_id, service_name, timestamp_ns // 3600000000000 * 3600000000000 AS start_ns, count(DISTINCT event_id) AS source_event_count, count(*) FILTER (signal = 'logs') AS log_count,
 {", ".join(f"count(*) FILTER (severity = '{s}') AS log_{s.lower()}_count" for s in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNSPECIFIED"))}, avg(body_bytes) AS log_body_bytes_mean, max(body_bytes) AS log_body_bytes_max,
 count(*) FILTER (signal = 'spans') AS span_count, count(*) FILTER (is_error) AS span_error_count, avg(duration_ms) AS span_duration_ms_mean, min(duration_ms) AS span_duration_ms_min, max(duration_ms) AS span_duration_ms_max,
 quantile_cont(duration_ms, 0.5) AS span_duration_ms_p50, quantile_cont(duration_ms, 0.95) AS span_duration_ms_p95, quantile_cont(duration_ms, 0.99) AS span_duration_ms_p99,
 {", ".join(f"count(*) FILTER (kind = '{k}') AS span_{k.lower()}_count" for k in otlp.SPAN_KINDS)}, count(DISTINCT operation) AS span_unique_operation_count, coalesce(sum(exceptions), 0)::BIGINT AS span_exception_event_count,
 count(DISTINCT metric_name) AS metric_name_count, count(*) FILTER (signal = 'metrics') AS metric_point_count, {", ".join(f"count(*) FILTER (metric_type = '{t}') AS metric_{t.lower()}_count" for t in otlp.METRIC_KINDS.values())}, count(*) AS telemetry_observation_count FROM o GROUP BY ALL),
x AS (SELECT *, {", ".join(f"coalesce(log_{s}_count / nullif(log_count, 0), 0) AS log_{s}_rate" for s in ("warn", "error", "fatal"))}, coalesce(span_error_count / nullif(span_count, 0), 0) AS span_error_rate, strftime(make_timestamp(start_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') AS window_start_utc FROM w),
y AS (SELECT * EXCLUDE ({", ".join(_FLOATS)}), {R(_FLOATS)}, sha256(run_id || '|' || service_name || '|' || window_start_utc || '|3600') AS window_id FROM x)"""


@query(f"WITH {_SERVICE_SQL} SELECT * FROM y")
def win_three_signals(spark, d):
    """Hourly windows over metrics, logs and spans, all read from OTLP lines."""
    return _rounded(signals.service_windows(seen(spark, d), 3600), *_FLOATS)


_MERGED = ("metric_value_mean", "histogram_sum", "histogram_mean", "summary_sum", "summary_mean")


@query(f"""WITH {SEEN_SQL}, w AS (SELECT run_id, service_name, timestamp_ns // 3600000000000 * 3600000000000 AS start_ns, metric_name, unit, metric_type, count(*) AS metric_point_count, count(DISTINCT series) AS metric_series_count, avg(numeric_value) AS metric_value_mean,
 count(aggregate_count) AS n, coalesce(sum(aggregate_count), 0)::BIGINT AS c, CASE WHEN count(aggregate_sum) = count(aggregate_count) THEN sum(aggregate_sum) END AS s, min(aggregate_min) AS histogram_min, max(aggregate_max) AS histogram_max FROM m GROUP BY ALL)
SELECT run_id, service_name, start_ns, metric_name, unit, metric_type, metric_point_count, metric_series_count, round(metric_value_mean, 6) AS metric_value_mean, histogram_min, histogram_max,
 {", ".join(f"CASE WHEN {c} THEN n ELSE 0 END AS {k}_datapoint_count, CASE WHEN {c} THEN c ELSE 0 END AS {k}_observation_count, CASE WHEN {c} THEN round(s, 6) END AS {k}_sum, CASE WHEN {c} THEN round(s / nullif(c, 0), 6) END AS {k}_mean" for k, c in (("histogram", "metric_type LIKE '%Histogram'"), ("summary", "metric_type = 'Summary'")))} FROM w""")
def win_metric_merged(spark, d):
    """Histograms and summaries merged by window, name, unit and type."""
    return _rounded(signals.merged_windows(parsed(spark, d)[0], 3600), *_MERGED)


@query(f"""WITH {SEEN_SQL} SELECT run_id, metric_name, unit, metric_type, count(*) AS points, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM m GROUP BY ALL""")
def metric_inventory(spark, d):
    return signals.metric_inventory(parsed(spark, d)[0], ("run_id",))


@query(f"""WITH {SEEN_SQL} SELECT metric_name, unit, metric_type, count(*) AS points, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM m GROUP BY ALL""")
def metric_inventory_merged(spark, d):
    return signals.metric_inventory(parsed(spark, d)[0])


@query(f"""WITH {SEEN_SQL} SELECT signal, coalesce(CASE signal WHEN 'logs' THEN severity WHEN 'spans' THEN kind END, metric_type) AS name, count(*) AS n FROM o GROUP BY ALL""")
def signal_kinds(spark, d):
    return signals.kind_counts(seen(spark, d))


@query(f"""WITH {SEEN_SQL}, q AS (SELECT signal, service_name, count(*) AS n, count(*) FILTER (timestamp_ns IS NULL) AS missing_time, count(*) FILTER (isinf(numeric_value) OR isnan(numeric_value) OR isnan(aggregate_sum)) AS non_finite, count(*) FILTER (invalid_duration) AS invalid_durations FROM o GROUP BY ALL)
SELECT *, missing_time / n AS missing_share, non_finite = 0 AND missing_time / n <= 0.01 AS passed FROM q""")
def signal_quality(spark, d):
    return signals.quality(seen(spark, d), 0.01)


@query(f"""WITH {SEEN_SQL} SELECT run_id, service_name, timestamp_ns, severity, body_bytes, count(*) AS n FROM l GROUP BY ALL""")
def otlp_logs(spark, d):
    """Logs read back: event time or else observed time, severities, bytes of bodies."""
    return parsed(spark, d)[1].groupBy("run_id", "service_name", "timestamp_ns", "severity", "body_bytes").agg(F.count("*").alias("n"))


@query(f"""WITH {SEEN_SQL} SELECT event_id::VARCHAR AS source_id, run_id, service_name, operation, kind, is_error, round(duration_ms, 6) AS duration_ms, exceptions, invalid_duration FROM s""")
def otlp_spans(spark, d):
    """Spans read back: durations, errors, exception events, ends before starts."""
    return _rounded(parsed(spark, d)[2].drop("timestamp_ns"), "duration_ms")


@query(f"""WITH {SEEN_SQL} SELECT event_id::VARCHAR AS source_id, metric_type, sha256('{{"series":"' || series || '"}}') AS series, numeric_value, aggregate_count, aggregate_sum, aggregate_min, aggregate_max FROM m""")
def otlp_points(spark, d):
    """Points read back: series as the hash of canonical attributes, values by kind."""
    return parsed(spark, d)[0].select("source_id", "metric_type", "series", "numeric_value", "aggregate_count", "aggregate_sum", "aggregate_min", "aggregate_max")


@query(f"""WITH {SEEN_SQL} SELECT CASE WHEN user_id % 23 = 0 THEN '  ' ELSE service_name END || ',old' AS names, count(*) AS n FROM e WHERE k3 = 1 AND user_id % 23 = 0 GROUP BY 1 UNION ALL SELECT 'old,' || service_name, count(*) FROM e WHERE k3 = 1 AND user_id % 23 <> 0 GROUP BY 1""")
def record_services(spark, d):
    """All service names of a record, sorted."""
    line = lines(spark, d)[1]
    names = otlp.service_names(line, otlp.LOGS, "resourceLogs", otlp.payload(F.col("line")))
    return line.select(F.array_join(names, ",").alias("names")).groupBy("names").agg(F.count("*").alias("n"))


_COUNTS, _RATES, _DURATIONS = ["log_count", "span_count", "metric_point_count"], ["log_warn_rate", "log_error_rate", "span_error_rate"], ["span_duration_ms_min", "span_duration_ms_max"]


@query(f"""WITH {_SERVICE_SQL} SELECT count(*) AS n, 0::BIGINT AS empty_window, 0::BIGINT AS negative_count, count(*) FILTER (log_warn_rate > 1 OR log_error_rate > 1 OR span_error_rate > 1) AS rate_outside, count(*) FILTER (span_duration_ms_min < 0 OR span_duration_ms_max < 0) AS negative_duration, 0::BIGINT AS not_finite FROM y""")
def feature_gate(spark, d):
    w = signals.service_windows(seen(spark, d), 3600).withColumn("end_ns", F.col("start_ns") + 3600 * 10**9)
    return signals.feature_gate(w, _COUNTS, _RATES, _DURATIONS, "start_ns", "end_ns")


@query(f"""WITH {_SERVICE_SQL} SELECT count(*) AS n, count(*) - count(DISTINCT window_id) AS repeated, count(*) FILTER (window_id <> sha256(run_id || '|' || service_name || '|' || window_start_utc || '|3600')) AS wrong_key, count(*) FILTER (run_id IS NULL OR service_name IS NULL) AS missing FROM y""")
def table_gate(spark, d):
    """Identities recomputed, unique, and nothing missing."""
    w = signals.service_windows(seen(spark, d), 3600).withColumn("width", F.lit("3600"))
    return signals.table_gate(w, "window_id", ["run_id", "service_name", "window_start_utc", "width"], ["run_id", "service_name"])


_MEANS, _MAXIMA, _SUMS = ["log_warn_rate", "log_error_rate", "span_error_rate", "span_duration_ms_mean", "metric_name_count"], ["log_warn_rate", "log_error_rate", "log_fatal_rate", "span_error_rate", "span_duration_ms_p95", "span_duration_ms_p99"], ["log_count", "span_count", "span_exception_event_count", "metric_point_count", "telemetry_observation_count"]


@query(f"""WITH {_SERVICE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY telemetry_observation_count DESC, window_start_utc, service_name, window_id) AS r FROM y),
t AS (SELECT run_id, max(telemetry_observation_count) AS score_max, round(avg(telemetry_observation_count), 6) AS score_mean_top, min(telemetry_observation_count) AS score_min_top, round(stddev_pop(telemetry_observation_count), 6) AS score_std_top,
 {", ".join(f"round(avg(coalesce({c}, 0)), 5) AS {c}_top_mean" for c in _MEANS)}, {", ".join(f"round(max(coalesce({c}, 0)), 5) AS {c}_top_max" for c in _MAXIMA)}, {", ".join(f"sum(coalesce({c}, 0)::DOUBLE) AS {c}_top_sum" for c in _SUMS)} FROM r WHERE r <= 3 GROUP BY run_id)
SELECT t.*, exceed_count, eligible_window_count FROM t JOIN (SELECT run_id, count(*) FILTER (telemetry_observation_count > 5) AS exceed_count, count(*) AS eligible_window_count FROM y GROUP BY run_id) USING (run_id)""")
def run_features(spark, d):
    """Features of a run from its three busiest windows."""
    w = _rounded(signals.service_windows(seen(spark, d), 3600), *_FLOATS)
    f = signals.run_features(w, "telemetry_observation_count", ["window_start_utc", "service_name", "window_id"], F.col("telemetry_observation_count") > 5, _MEANS, _MAXIMA, _SUMS)
    f = _rounded(f, "score_mean_top", "score_std_top")
    for c in f.columns:
        if c.endswith(("_top_mean", "_top_max")) and not c.startswith("score"):
            f = f.withColumn(c, F.round(c, 5))
    return f


@query(f"""WITH {_SERVICE_SQL}, c AS (SELECT *, ['normal', 'cpu', 'disk'][(hour(make_timestamp(start_ns // 1000)) % 3 + 1)::INT] AS scenario FROM y)
SELECT CASE scenario WHEN 'normal' THEN 'normal_negative' WHEN 'cpu' THEN CASE WHEN service_name IN ('svc-1', 'svc-2') THEN 'injected_positive' ELSE 'propagation_ambiguous' END ELSE CASE WHEN service_name = 'svc-3' THEN 'injected_positive' ELSE 'propagation_ambiguous' END END AS role, count(*) AS n, sum(telemetry_observation_count)::BIGINT AS observations FROM c GROUP BY 1""")
def ground_truth_roles(spark, d):
    """Windows by whether the scenario's fault hits their service; the scenario is chosen by the hour."""
    w = signals.service_windows(seen(spark, d), 3600)
    hour = F.floor(F.col("start_ns") / (3600 * 10**9)) % 24
    w = w.withColumn("scenario", F.element_at(F.array(*map(F.lit, ("normal", "cpu", "disk"))), (hour % 3 + 1).cast("int")))
    expected = spark.createDataFrame([("normal", []), ("cpu", ["svc-1", "svc-2"]), ("disk", ["svc-3"])], "scenario string, services array<string>")
    return signals.ground_truth(w, expected).groupBy("role").agg(F.count("*").alias("n"), F.sum("telemetry_observation_count").alias("observations"))
