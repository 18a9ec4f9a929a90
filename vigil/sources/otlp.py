"""OTLP JSON lines as typed observations. 64-bit integers arrive as strings, enumerations as names or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.columns import severity_group

#: Fixed name of a service that its resource doesn't tell.
UNKNOWN = "__unknown__"
_VALUE = "struct<stringValue: string, boolValue: boolean, intValue: string, doubleValue: double>"
_ATTRS = f"array<struct<key: string, value: {_VALUE}>>"
_POINT = f"struct<attributes: {_ATTRS}, timeUnixNano: string, asDouble: double, asInt: string, count: string, sum: double, min: double, max: double>"
_KIND = f"struct<dataPoints: array<{_POINT}>>"
METRICS = f"resourceMetrics array<struct<resource: struct<attributes: {_ATTRS}>, scopeMetrics: array<struct<metrics: array<struct<name: string, unit: string, gauge: {_KIND}, sum: {_KIND}, histogram: {_KIND}, exponentialHistogram: {_KIND}, summary: {_KIND}>>>>>>"
LOGS = f"resourceLogs array<struct<resource: struct<attributes: {_ATTRS}>, scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: string, body: struct<stringValue: string, bytesValue: string, boolValue: boolean, intValue: string, doubleValue: double, arrayValue: struct<values: array<{_VALUE}>>, kvlistValue: struct<values: {_ATTRS}>>>>>>>>"
SPANS = f"resourceSpans array<struct<resource: struct<attributes: {_ATTRS}>, scopeSpans: array<struct<spans: array<struct<name: string, kind: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: string>, events: array<struct<name: string>>>>>>>>"
#: Fixed names of metric kinds by field, and of span kinds by number.
METRIC_KINDS = {"gauge": "Gauge", "sum": "Sum", "histogram": "Histogram", "exponentialHistogram": "ExponentialHistogram", "summary": "Summary"}
SPAN_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
_SEVERITY_BASE = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}


def _service(attributes: Column) -> Column:
    """The resource's service.name, the last one if it has several; absent, blank and other than text are unknown."""
    named = F.filter(attributes, lambda a: a["key"] == "service.name")
    name = F.try_element_at(named, F.lit(-1))["value"]["stringValue"]
    return F.when(F.regexp_like(name, F.lit(r"\S")), name).otherwise(UNKNOWN)


def _run(attributes: Column) -> Column:
    """The attribute run.id of a resource; null without one."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == "run.id"), F.lit(-1))["value"]["stringValue"]


def last_of_each(attributes: Column) -> Column:
    """Attributes sorted by key; of repeated keys the last one."""
    keys = F.array_sort(F.array_distinct(F.transform(attributes, lambda a: a["key"])))
    return F.transform(keys, lambda k: F.element_at(F.filter(attributes, lambda a: a["key"] == k), -1))


def native(value: Column) -> Column:
    """A value as JSON text: text quoted, whole numbers, doubles and booleans as they are; null without one."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.coalesce(F.when(value["stringValue"].isNotNull(), one(value["stringValue"])), F.when(value["boolValue"].isNotNull(), one(value["boolValue"])), value["intValue"], F.when(value["doubleValue"].isNotNull(), one(value["doubleValue"])), F.lit("null"))


def canonical(attributes: Column) -> Column:
    """Attributes as a JSON object with sorted keys and no blanks."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(last_of_each(attributes), lambda a: F.concat(one(a["key"]), F.lit(":"), native(a["value"]))), ","), F.lit("}"))


def record_id(line: Column, signal: str, run: Column | None = None) -> Column:
    """Identity of a record: its own event_id, else a hash of run, signal and the record's text."""
    own = F.get_json_object(line, "$.event_id")
    return F.coalesce(own, F.sha2(F.concat_ws("|", run if run is not None else F.lit(""), F.lit(signal), line), 256))


def payload(line: Column) -> Column:
    """The record inside an {event_id, payload} envelope, or the line itself."""
    return F.coalesce(F.get_json_object(line, "$.payload"), line)


def records(lines: DataFrame, signal: str, root: str, line: str = "line") -> DataFrame:
    """One row for each line that isn't blank: (line, source_id), with whether the root is an array (`rooted`; a missing one counts as empty)."""
    r = lines.where(F.regexp_like(line, F.lit(r"\S"))).select(record_id(F.col(line), signal).alias("source_id"), payload(F.col(line)).alias("line"))
    at = F.trim(F.get_json_object("line", f"$.{root}"))
    return r.withColumn("rooted", F.coalesce(at.startswith("["), F.try_parse_json("line").isNotNull()))


def service_names(lines: DataFrame, kind: str, root: str, line: str = "line") -> Column:
    """Sorted distinct service names of a record's resources that aren't empty."""
    every = F.flatten(F.transform(F.from_json(line, kind)[root], lambda r: F.filter(r["resource"]["attributes"], lambda a: a["key"] == "service.name")))
    names = F.transform(every, lambda a: a["value"]["stringValue"])
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))), F.expr("cast(array() as array<string>)"))

def _positive(text: Column) -> Column:
    n = text.try_cast("long")
    return F.when(n > 0, n)


def metric_observations(lines: DataFrame, line: str = "line") -> DataFrame:
    """(source_id, run_id, service_name, timestamp_ns, metric_name, unit, metric_type, series, numeric_value, aggregate_count, aggregate_sum,
    aggregate_min, aggregate_max): one row for each data point."""
    r = records(lines, "metrics", "resourceMetrics", line).select("source_id", F.explode(F.from_json("line", METRICS)["resourceMetrics"]).alias("r"))
    m = r.select("source_id", _run(F.col("r.resource.attributes")).alias("run_id"), _service(F.col("r.resource.attributes")).alias("service_name"), F.explode(F.flatten(F.transform("r.scopeMetrics", lambda s: s["metrics"]))).alias("m"))
    typed = lambda f, name: F.transform(F.col(f"m.{f}.dataPoints"), lambda p: F.struct(F.lit(name).alias("type"), p.alias("p")))
    kinds = [typed(f, name) for f, name in METRIC_KINDS.items()]
    none = F.array().cast(f"array<struct<type: string, p: {_POINT}>>")
    p = m.select("source_id", "run_id", "service_name", F.col("m.name").alias("metric_name"), F.coalesce("m.unit", F.lit("")).alias("unit"), F.explode(F.concat(*(F.coalesce(k, none) for k in kinds))).alias("x"))
    point, bounded = F.col("x.p"), F.col("x.type").isin("Histogram", "ExponentialHistogram")
    merged = bounded | (F.col("x.type") == "Summary")
    return p.select(
        "source_id", "run_id", "service_name", _positive(point["timeUnixNano"]).alias("timestamp_ns"), "metric_name", "unit", F.col("x.type").alias("metric_type"),
        F.sha2(canonical(F.coalesce(point["attributes"], F.array().cast(_ATTRS))), 256).alias("series"),
        F.when(F.col("x.type").isin("Gauge", "Sum"), F.coalesce(point["asDouble"], point["asInt"].try_cast("double"))).alias("numeric_value"),
        F.when(merged, F.coalesce(point["count"].try_cast("long"), F.lit(0))).alias("aggregate_count"),
        F.when(merged, F.when(F.col("x.type") == "Summary", F.coalesce(point["sum"], F.lit(0.0))).otherwise(point["sum"])).alias("aggregate_sum"),
        F.when(bounded, point["min"]).alias("aggregate_min"), F.when(bounded, point["max"]).alias("aggregate_max"),
    )


def _structured(body: Column) -> Column:
    """A body that holds a number, a truth value, a list or a map of plain values, as canonical JSON; null otherwise."""
    plain = F.coalesce(F.when(body["boolValue"].isNotNull(), body["boolValue"].cast("string")), body["intValue"], body["doubleValue"].cast("string"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(body["arrayValue"]["values"], native), ","), F.lit("]"))
    return F.coalesce(plain, listed, canonical(body["kvlistValue"]["values"]))


def log_observations(lines: DataFrame, line: str = "line") -> DataFrame:
    """(source_id, run_id, service_name, timestamp_ns, severity, body_bytes): one row for each record; the observed time where its own is unset.
    A body that is neither text nor bytes counts as its canonical JSON, a missing one as null."""
    r = records(lines, "logs", "resourceLogs", line).select("source_id", F.explode(F.from_json("line", LOGS)["resourceLogs"]).alias("r"))
    x = r.select("source_id", _run(F.col("r.resource.attributes")).alias("run_id"), _service(F.col("r.resource.attributes")).alias("service_name"), F.explode(F.flatten(F.transform("r.scopeLogs", lambda s: s["logRecords"]))).alias("x"))
    raw = F.coalesce(F.col("x.severityNumber"), F.lit("0"))
    name = F.regexp_extract(raw, "SEVERITY_NUMBER_([A-Z]+)", 1)
    step = F.coalesce(F.regexp_extract(raw, "([0-9])$", 1).try_cast("int"), F.lit(1)) - 1
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in _SEVERITY_BASE.items() for v in kv)), name), F.lit(0))
    number = F.coalesce(raw.try_cast("int"), F.when(base > 0, base + step).otherwise(0))
    body = F.coalesce(F.octet_length("x.body.stringValue"), F.octet_length(F.unbase64("x.body.bytesValue")), F.octet_length(_structured(F.col("x.body"))), F.lit(4))
    return x.select("source_id", "run_id", "service_name", F.coalesce(_positive(F.col("x.timeUnixNano")), _positive(F.col("x.observedTimeUnixNano"))).alias("timestamp_ns"), severity_group(number).alias("severity"), body.cast("long").alias("body_bytes"))


def span_observations(lines: DataFrame, line: str = "line") -> DataFrame:
    """(source_id, run_id, service_name, timestamp_ns, operation, kind, is_error, duration_ms, exceptions, invalid_duration): a span that ends
    before it starts keeps counting, without duration."""
    r = records(lines, "traces", "resourceSpans", line).select("source_id", F.explode(F.from_json("line", SPANS)["resourceSpans"]).alias("r"))
    x = r.select("source_id", _run(F.col("r.resource.attributes")).alias("run_id"), _service(F.col("r.resource.attributes")).alias("service_name"), F.explode(F.flatten(F.transform("r.scopeSpans", lambda s: s["spans"]))).alias("x"))
    raw = F.coalesce(F.col("x.kind"), F.lit("0"))
    number = F.coalesce(raw.try_cast("int"), F.array_position(F.array(*map(F.lit, SPAN_KINDS)), F.regexp_replace(raw, "^SPAN_KIND_", "")).cast("int") - 1)
    kind = F.when(number.between(0, 5), F.element_at(F.array(*map(F.lit, SPAN_KINDS)), F.greatest(number, F.lit(0)) + 1)).otherwise("UNSPECIFIED")
    a, b = _positive(F.col("x.startTimeUnixNano")), F.coalesce(F.col("x.endTimeUnixNano").try_cast("long"), F.lit(0))
    exceptions = F.size(F.filter(F.coalesce("x.events", F.array().cast("array<struct<name: string>>")), lambda e: e["name"] == "exception"))
    return x.select(
        "source_id", "run_id", "service_name", a.alias("timestamp_ns"), F.coalesce("x.name", F.lit("")).alias("operation"), kind.alias("kind"), F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)).alias("is_error"),
        F.when(b >= a, (b - a) / 1e6).alias("duration_ms"), exceptions.cast("long").alias("exceptions"), (b < F.coalesce(a, F.lit(0))).alias("invalid_duration"),
    )
