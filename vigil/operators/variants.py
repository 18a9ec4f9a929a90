"""JSON of any depth as rows of its leaves, strict field sets, canonical text, and nested measures as flat names."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY = "stringValue boolValue intValue doubleValue bytesValue kvlistValue.values.key"
_POINT = "startTimeUnixNano timeUnixNano flags"
#: Fixed field names of OTLP messages: the fields of each place, below it. @ stands for a place with an AnyValue, * for one with attributes.
OTLP_FIELDS = {
    "resourceMetrics": "schemaUrl", "resourceMetrics.resource": "*", "resourceMetrics.scopeMetrics": "schemaUrl", "resourceMetrics.scopeMetrics.scope": "name version *",
    "resourceMetrics.scopeMetrics.metrics": "name description unit metadata.key metadata.value@", "resourceMetrics.scopeMetrics.metrics.gauge.dataPoints": f"{_POINT} asDouble asInt *",
    "resourceMetrics.scopeMetrics.metrics.sum": "aggregationTemporality isMonotonic", "resourceMetrics.scopeMetrics.metrics.sum.dataPoints": f"{_POINT} asDouble asInt *",
    "resourceMetrics.scopeMetrics.metrics.histogram": "aggregationTemporality", "resourceMetrics.scopeMetrics.metrics.histogram.dataPoints": f"{_POINT} count sum bucketCounts explicitBounds min max *",
    "resourceMetrics.scopeMetrics.metrics.exponentialHistogram": "aggregationTemporality",
    "resourceMetrics.scopeMetrics.metrics.exponentialHistogram.dataPoints": f"{_POINT} count sum scale zeroCount zeroThreshold positive.offset positive.bucketCounts negative.offset negative.bucketCounts min max *",
    "resourceMetrics.scopeMetrics.metrics.summary.dataPoints": f"{_POINT} count sum quantileValues.quantile quantileValues.value *",
    "resourceLogs": "schemaUrl", "resourceLogs.resource": "*", "resourceLogs.scopeLogs": "schemaUrl", "resourceLogs.scopeLogs.scope": "name version *",
    "resourceLogs.scopeLogs.logRecords": "timeUnixNano observedTimeUnixNano severityNumber severityText flags traceId spanId eventName body@ *",
    "resourceSpans": "schemaUrl", "resourceSpans.resource": "*", "resourceSpans.scopeSpans": "schemaUrl", "resourceSpans.scopeSpans.scope": "name version *",
    "resourceSpans.scopeSpans.spans": "traceId spanId traceState parentSpanId flags name kind startTimeUnixNano endTimeUnixNano droppedEventsCount droppedLinksCount status.message status.code *",
    "resourceSpans.scopeSpans.spans.events": "timeUnixNano name *", "resourceSpans.scopeSpans.spans.links": "traceId spanId traceState flags *",
}


def otlp_paths() -> set[str]:
    """Paths of all leaves that a record may have, without places in lists; a value inside a list or map value counts as that value's own."""
    value = lambda at: {f"{at}.{x}" for x in _ANY.split()}
    out = set()
    for at, fields in OTLP_FIELDS.items():
        for f in fields.split():
            if f == "*":
                out |= {f"{at}.droppedAttributesCount", f"{at}.attributes.key"} | value(f"{at}.attributes.value")
            else:
                out |= value(f"{at}.{f[:-1]}") if f.endswith("@") else {f"{at}.{f}"}
    return out


def _whole(s: str) -> tuple[str, str]:
    return ("long", "0" if s == "-0" else s) if len(s) <= 18 else ("number", s)


def _part(s: str) -> tuple[str, str]:
    if len(s) > 30 or "e" in s or "E" in s:
        return "number", s
    s = s.rstrip("0").rstrip(".")
    return "decimal", "0" if s == "-0" else s


#: Numbers become (type, text) as Spark's variants have them; long ones and those with an exponent stay as written, for Spark to say. What follows a whole value is left alone, as by try_parse_json.
_DECODER = json.JSONDecoder(parse_int=_whole, parse_float=_part, strict=False)


def _walk(value) -> list[tuple[str, str, str | None]]:
    """(path, type, text) of each leaf, with type number for what Spark still has to tell apart."""
    out, left = [], [("", value)]
    while left:
        path, x = left.pop()
        if isinstance(x, dict):
            if not x:
                out.append((path, "object", None))
            left += [(f"{path}.{k}" if path else k, y) for k, y in x.items()]
        elif isinstance(x, list):
            if not x:
                out.append((path, "array", None))
            left += [(f"{path}[{i}]", y) for i, y in enumerate(x)]
        elif x is None:
            out.append((path, "null", None))
        elif isinstance(x, bool):
            out.append((path, "boolean", "true" if x else "false"))
        else:
            out.append((path, *x) if isinstance(x, tuple) else (path, "string", x))
    return out


def _arrow_texts(texts: list[str | None]) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:  # half of a surrogate pair becomes ?, as in Spark
        return pa.array([t if t is None else t.encode("utf-8", "replace").decode() for t in texts], pa.string())


def _opened(batches):
    """Batches of (_key, text as bytes, valid) as batches of leaves, of some ten thousand each."""
    names = ["_key", "path", "type", "value"]
    for b in batches:
        rows, found = [], []

        def flush(b=b):
            columns = list(zip(*found)) if found else [()] * 3
            return pa.RecordBatch.from_arrays([b["_key"].take(pa.array(rows, pa.int32())), _arrow_texts(columns[0]), pa.array(columns[1], pa.string()), _arrow_texts(columns[2])], names=names)

        for i, (raw, valid) in enumerate(zip(b["text"], b["valid"].to_pylist())):
            text = raw.as_py().decode("utf-8", "replace")
            own = _walk(_DECODER.raw_decode(text, len(text) - len(text.lstrip(" \t\n\r")))[0]) if valid else [("", "invalid", text)]
            found += own
            rows += [i] * len(own)
            if len(rows) >= 20_000:
                yield flush()
                rows, found = [], []
        yield flush()


def leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, type, value): a row for each leaf of each row's JSON text, whatever its depth. Paths are like a.b[0].c; types are string, long, double, decimal,
    boolean, null, and object or array for empty ones.

    A text that is no JSON, or repeats a field of an object, has one row of type invalid; a null text has none. Null and repeated keys stay as they are.
    One narrow stage: Spark says whether a text is JSON and what type an unusual number has, tasks walk the texts, so nothing is written on the way."""
    kind = dict(rows.select(F.col(key).alias("_key")).dtypes)["_key"]
    given = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null").select("_key", F.col("_text").cast("binary").alias("text"), F.try_parse_json("_text").isNotNull().alias("valid"))
    found = given.mapInArrow(_opened, f"_key {kind}, path string, type string, value string")
    number = F.when(F.col("type") == "number", F.try_parse_json("value"))
    name = F.lower(F.regexp_extract(F.schema_of_variant(number), r"^\w+", 0))
    return found.select(
        F.col("_key").alias(key), "path", F.when(F.col("type") != "number", F.col("type")).when(name == "bigint", "long").otherwise(name).alias("type"),
        F.when(F.col("type") == "number", number.cast("string")).otherwise(F.col("value")).alias("value"),
    )


def unknown_fields(found: DataFrame, key: str, allowed: set[str]) -> DataFrame:
    """(key, unknown): for every key of leaves the sorted distinct paths that no allowed field has, without places in lists. A path above an allowed one may
    only be an empty object or list. A text that is no JSON has the path ''."""
    above = {p.rsplit(".", k)[0] for p in allowed for k in range(1, p.count(".") + 1)}
    plain = F.regexp_replace("path", r"\[[0-9]+\]", "")
    own = F.regexp_replace(plain, r"(\.arrayValue\.values|\.kvlistValue\.values\.value)+", "")
    empty = F.col("type").isin("object", "array")
    lists = {f"{p.removesuffix('.stringValue')}.{x}" for p in allowed if p.endswith(".stringValue") for x in ("arrayValue", "kvlistValue")}
    ok = own.isin(*sorted(allowed)) & ~empty | empty & (own.isin(*sorted(allowed | above | lists)) | (own == "") & (F.col("type") == "object"))
    each = found.select(key, F.when(~ok, plain).alias("_plain")).distinct()  # most leaves of a key become one row before they travel
    return each.groupBy(key).agg(F.array_sort(F.collect_list("_plain")).alias("unknown"))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted fields at every depth and no blanks; null for what is no JSON. Numbers are written one way: 1.50 as 1.5."""
    return F.to_json(F.try_parse_json(text))


def scalar_measures(found: DataFrame, key: str) -> DataFrame:
    """(key, name, value): leaves that are finite numbers or truth values (as 0 and 1), by dotted names; places in lists become parts of the name."""
    name = F.regexp_replace("path", r"\[([0-9]+)\]", ".$1")
    number = F.when(F.col("type") == "boolean", F.when(F.col("value") == "true", 1.0).otherwise(0.0)).when(F.col("type").isin("long", "double", "decimal"), F.col("value").try_cast("double"))
    return found.select(key, F.regexp_replace(name, r"^\.", "").alias("name"), number.alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
