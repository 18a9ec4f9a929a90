"""JSON Schemas as columns of failures, exact field sets, the structure of benchmarks and the targets of their grades."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.variants import _arrow_texts

_TEXT, _COUNT = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}
_OPEN = {"type": ["string", "null"]}


def _record(fields: dict, **more) -> dict:
    """An object with exactly these fields."""
    return {"type": "object", "additionalProperties": False, "required": [*fields], "properties": fields, **more}


_TRUTH = _record({"run_id": _OPEN, "scenario": _OPEN, "label": _OPEN})
#: Fixed contracts of outgoing events.
PROCESSED_EVENT = _record({
    "schema_version": {"const": 1}, "event_id": {"type": "string", "pattern": "^[0-9a-f]{64}$"}, "event_type": {"const": "telemetry.processed"}, "produced_at_utc": {"type": "string", "format": "date-time"},
    "signal": {"enum": ["metrics", "logs", "traces"]}, "source": _record({"topic": {"const": "telemetry.raw"}, "partition": _COUNT, "offset": _COUNT}),
    "service_names": {"type": "array", "items": _TEXT, "uniqueItems": True}, "ground_truth": _TRUTH, "payload": {"type": "object"},
})
DEAD_LETTER = _record({
    "schema_version": {"const": 1}, "event_type": {"const": "telemetry.dlq"}, "failed_at_utc": {"type": "string", "format": "date-time"}, "source": _record({"topic": _TEXT, "partition": _COUNT, "offset": _COUNT}),
    "headers": {"type": "object", "additionalProperties": _OPEN},
    "error": _record({"category": {"enum": ["missing_header", "unsupported_signal", "invalid_utf8", "invalid_json", "invalid_otlp_structure", "processed_schema_validation", "processing_error"]}, "message": _TEXT}),
    "processing_attempt_count": {"type": "integer", "minimum": 1}, "raw_payload": _record({"encoding": {"const": "base64"}, "data": {"type": "string"}}), "ground_truth": _TRUTH,
})
#: Fixed field sets of benchmark records.
QUERY_RECORD = _record({f: {"type": "string", "pattern": r"\S"} for f in ("query_id", "query", "incident_type", "style", "split")})
QREL_RECORD = _record({"query_id": {}, "source_path": {}, "heading_path": {"type": "array", "minItems": 1, "items": _TEXT}, "grade": {"enum": [1, 2]}})


def inference_request(features: list[str], windows: int = 1000) -> dict:
    """The contract of a request to score feature windows: these names in this order, as many values in each window, finite or null."""
    name, n = {"type": "string", "minLength": 1, "maxLength": 200}, len(features)
    window = _record({"window_id": name, "service_name": name, "window_start_utc": {"type": "string", "format": "date-time"}, "window_end_utc": {"type": "string", "format": "date-time"}, "values": {"type": "array", "minItems": n, "maxItems": n, "items": {"type": ["number", "null"]}}})
    return _record({"schema_version": {"const": "ml_inference_v1"}, "feature_schema_version": {"const": 1}, "input_id": name, "feature_names": {"const": features}, "windows": {"type": "array", "minItems": 1, "maxItems": windows, "items": window}})


_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
_KNOWN = {"type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties"} | {
    "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"}
_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)", re.ASCII).fullmatch
_UTC = re.compile(r"[1-9]\d{3}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.(\d{1,6}))?Z", re.ASCII).fullmatch
_DAYS = (0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Bytes of messages that a task opens at a time; a larger message is opened alone.
_OPENED = 1 << 22


def _kind(v: Column) -> Column:
    k = F.substring_index(F.schema_of_variant(v), "<", 1)
    names = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "OBJECT": "object", "ARRAY": "array", "BIGINT": "long"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), k), F.lit("number"))


def _plain(value):
    """A constant as the JSON text that a variant of it has."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(x) for k, x in value.items()}
    return [_plain(x) for x in value] if isinstance(value, list) else value


class _Written(float):
    """A number that remembers its text."""

    def __new__(cls, text):
        made = super().__new__(cls, text)
        made.text = text
        return made


def _text(v) -> str:
    """A value as JSON with its numbers as they were written."""
    if type(v) is dict:
        return "{" + ",".join(f"{json.dumps(k)}:{_text(x)}" for k, x in v.items()) + "}"
    if type(v) is list:
        return "[" + ",".join(map(_text, v)) + "]"
    return v.text if type(v) is _Written else json.dumps(v)


_TYPES = {"null": [type(None)], "boolean": [bool], "integer": [int], "number": [int, float, _Written], "string": [str], "array": [list], "object": [dict]}
_WHOLE = [float, _Written]
_BOUNDS = {
    "number": {"minimum": lambda b: lambda x: x < b, "maximum": lambda b: lambda x: x > b, "exclusiveMinimum": lambda b: lambda x: x <= b, "exclusiveMaximum": lambda b: lambda x: x >= b},
    "string": {"minLength": lambda b: lambda x: len(x) < b, "maxLength": lambda b: lambda x: len(x) > b}, "array": {"minItems": lambda b: lambda x: len(x) < b, "maxItems": lambda b: lambda x: len(x) > b},
    "object": {"minProperties": lambda b: lambda x: len(x) < b, "maxProperties": lambda b: lambda x: len(x) > b},
}


def _differs(kind: type, values: list):
    """Whether a value of this type is none of these; lists and objects are left to Spark."""
    if kind is str:
        texts = frozenset(x for x in values if isinstance(x, str))
        return lambda v: v not in texts
    plain = [x for x in values if x is not None and not isinstance(x, (str, dict, list)) and isinstance(x, bool) == (kind is bool)]
    return (lambda v: v not in plain) if kind in (bool, int, float, _Written) else lambda v: kind is not type(None) or None not in values


def _real(text: str) -> bool:
    """Whether a text is a date-time with a real date, no leap second."""
    if not (m := _STAMP(text)):
        return False
    year, month, day, hour, minute, second = map(int, m.groups())
    if not 1 <= month <= 12 or hour > 23 or minute > 59 or second > 59:
        return False
    return 1 <= day <= _DAYS[month] + (month == 2 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0))


def _never(word: str):
    return {t: [(f": {word}", lambda x: True)] for ts in _TYPES.values() for t in ts}, {}


def _check(schema, asks: list[tuple]):
    """(own, deep) by a value's type: pairs of ": keyword" and what breaks it, and a function of (value, path, failures) for what takes more. None where nothing can break.
    Failures are (text, question, value's text). One with a question is one only if Spark finds so: asks gets these questions, as (keyword, its value), in the schema's order."""
    if schema is True or schema == {}:
        return None
    if schema is False:
        return _never("never")
    unknown = set(schema) - _KNOWN - _NOTES
    if unknown or schema.get("format", "date-time") != "date-time":
        raise ValueError(f"keywords that have no column: {sorted(unknown) or schema['format']}")
    own, asked = {t: [] for ts in _TYPES.values() for t in ts}, {t: [] for t in (str, list, dict)}
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        for t in own.keys() - {t for n in names for t in _TYPES[n]}:
            own[t].append((": type", (lambda x: not x.is_integer()) if t in _WHOLE and "integer" in names else lambda x: True))

    def ask(kinds, word, value):
        for t in kinds:
            asked[t].append((f": {word}", len(asks)))
        asks.append((word, value))

    for word, values in (("const", [schema.get("const")]), ("enum", schema.get("enum"))):
        if word in schema:
            deep = [x for x in values if isinstance(x, (dict, list))]
            for t in own:
                if not deep or t not in (dict, list):
                    own[t].append((f": {word}", _differs(t, values)))
            if deep:
                ask((dict, list), word, deep)
    for kind, words in _BOUNDS.items():
        for word in words.keys() & schema.keys():
            for t in _TYPES[kind]:
                own[t].append((f": {word}", words[word](schema[word])))
    if "pattern" in schema:
        ask([str], "pattern", schema["pattern"])
    if "format" in schema:
        own[str].append((": format", lambda x: not _real(x)))
    if schema.get("uniqueItems"):
        ask([list], "uniqueItems", True)
    required, named = schema.get("required", []), {n: _check(sub, asks) for n, sub in schema.get("properties", {}).items()}
    more = schema.get("additionalProperties", True)
    other = _never("additionalProperties") if more is False else _check(more, asks)
    items = _check(schema.get("items", True), asks)

    def ask_spark(v, at, out):
        for word, number in asked[type(v)]:
            out.append((at + word, number, v if type(v) is str else _text(v)))

    def fields(v, at, out):
        ask_spark(v, at, out)
        for n in required:
            if n not in v:
                out.append((f"{at}.{n}: required", None, None))
        for n, x in v.items():
            if (below := named.get(n, other)) is not None:
                own, deep = below
                t = type(x)
                for word, broken in own[t]:
                    if broken(x):
                        out.append((f"{at}.{n}{word}", None, None))
                if t in deep:
                    deep[t](x, f"{at}.{n}", out)

    def places(v, at, out):
        ask_spark(v, at, out)
        if items is not None:
            own, deep = items
            for i, x in enumerate(v):
                t = type(x)
                for word, broken in own[t]:
                    if broken(x):
                        out.append((f"{at}[{i}]{word}", None, None))
                if t in deep:
                    deep[t](x, f"{at}[{i}]", out)

    return own, {dict: fields, list: places} | ({str: ask_spark} if asked[str] else {})


def _windows(asks: list[tuple]):
    """A function of (request, failures) for what its windows need beside the contract: ids that differ, and ends after starts. Failures and asks are as in _check."""
    ids, order = len(asks), len(asks) + 1
    asks += [("window_id", None), ("window_order", None)]

    def moment(x):
        """What sorts as the time does; None where Spark has to read it."""
        m = _UTC(x) if type(x) is str else None
        return x[:19] + (m[1] or "").ljust(6, "0") if m and _real(x) else None

    def rules(v, out):
        windows = v.get("windows") if type(v) is dict else None
        if type(windows) is not list:
            return
        named = [w.get("window_id") if type(w) is dict else None for w in windows]
        if not all(x is None or type(x) is str for x in named):
            out.append(("$.windows: window_id", ids, _text(named)))
        elif len({x if x is None else x.encode("utf-8", "replace") for x in named}) < len(named):  # half of a surrogate pair is ?, as in Spark
            out.append(("$.windows: window_id", None, None))
        for i, w in enumerate(windows):
            start, end = (w.get("window_start_utc"), w.get("window_end_utc")) if type(w) is dict else (None, None)
            if start is None or end is None:
                continue
            a, b = moment(start), moment(end)
            if a is None or b is None:
                out.append((f"$.windows[{i}]: window_order", order, _text([start, end])))
            elif b <= a:
                out.append((f"$.windows[{i}]: window_order", None, None))

    return rules


def _slices(texts: pa.Array, valid: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A batch in parts of _OPENED bytes, or one text."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and size + (n or 0) > _OPENED:
            yield texts.slice(start, i - start), valid.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield texts.slice(start), valid.slice(start)


def _found(schema, more=None):
    """The task's part: batches of texts, and whether each is JSON, as lists of (failure, question, text). What a message becomes in Python is many times its bytes, so only a
    part of a batch is opened at a time. more: like _windows."""
    kind = pa.list_(pa.struct([("failure", pa.string()), ("question", pa.int32()), ("text", pa.string())]))

    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        asks: list[tuple] = []
        rule, rules = _check(schema, asks), more(asks) if more else None
        exact = {"parse_float": _Written} if any(w != "pattern" for w, _ in asks) else {}
        decoder = json.JSONDecoder(strict=False, **exact)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # JSON may lie 1,000 deep
        sys.set_int_max_str_digits(0)
        for texts, valid in (part for batch in batches for part in _slices(*batch)):
            out, ends = [], [0]
            for raw, ok in zip(texts, valid.to_pylist()):
                if ok:
                    text = raw.as_py().decode("utf-8", "replace")
                    value = decoder.raw_decode(text, len(text) - len(text.lstrip(" \t\n\r")))[0]
                    if rule is not None:
                        own, deep = rule
                        out += ((f"${word}", None, None) for word, broken in own[type(value)] if broken(value))
                        if type(value) in deep:
                            deep[type(value)](value, "$", out)
                    if rules is not None:
                        rules(value, out)
                else:
                    out.append(("$: json", None, None))
                ends.append(len(out))
            failures, questions, values = zip(*out) if out else ((), (), ())
            each = pa.StructArray.from_arrays([_arrow_texts(failures), pa.array(questions, pa.int32()), _arrow_texts(values)], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return found


def _breaks(word: str, value, text: Column) -> Column:
    """The answer to a question."""
    if word == "pattern":
        return ~F.rlike(text, F.lit(value))
    v = F.try_parse_json(text)
    if word == "window_id":
        ids = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        return F.size(F.array_distinct(ids)) < F.size(ids)
    if word == "window_order":
        start, end = (F.try_to_timestamp(F.try_variant_get(v, f"$[{i}]", "string")) for i in (0, 1))
        return end <= start
    if word == "uniqueItems":
        items = F.try_variant_get(v, "$", "array<variant>")
        alike = F.transform(items, lambda x: F.coalesce(F.when(_kind(x).isin("long", "number"), F.try_variant_get(x, "$", "double").cast("string")), F.to_json(x)))
        return F.size(F.array_distinct(alike)) < F.size(items)
    return ~F.to_json(v).isin(*(json.dumps(_plain(x), separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in value))


def _errors(schema: dict, text: Column, more=None) -> Column:
    asks: list[tuple] = []
    _check(schema, asks)
    if more:
        more(asks)
    found = F.arrow_udf(_found(schema, more), "array<struct<failure: string, question: int, text: string>>")(text.cast("binary"), F.try_parse_json(text).isNotNull())

    def stands(e):
        answer = F.when(e["question"].isNull(), True)
        for i, (word, value) in enumerate(asks):
            answer = answer.when(e["question"] == i, _breaks(word, value, e["text"]))
        return F.coalesce(answer, F.lit(False))

    return F.sort_array((F.filter(found, stands) if asks else found)["failure"])


def schema_errors(schema: dict, text: Column) -> Column:
    """All failures of a JSON text against a JSON Schema, as sorted texts like "$.source.offset: minimum"; empty for a valid one.

    Spark says whether a text is JSON, tasks walk the texts on Arrow batches, and what depends on Java's texts and patterns is asked of Spark again. Keywords are those
    of _KNOWN and format date-time, which needs a real date and no leap second; others raise an error here instead of passing unseen. Lengths count code points; a pattern is
    searched for, as Java reads it. 1 and 1.0 are equal, and whole numbers of any size are integers; inside lists and objects of const, enum and uniqueItems texts are
    compared instead. What is no JSON, null, repeats a field or is too long for Spark's variants (some 250 MB of text) fails with "$: json"."""
    return _errors(schema, text)


def request_errors(features: list[str], text: Column, most: int = 1000) -> Column:
    """Failures of a request to score windows: those of its contract, ids that repeat, and windows that end at or before their start. Times that aren't plain UTC, and ids that
    aren't texts, are compared as Spark casts them."""
    return _errors(inference_request(features, most), text, _windows)


def structure_checks(queries: DataFrame, qrels: DataFrame, by: dict[str, dict[str, int]], within: tuple[str, str, dict[str, dict[str, int]]] | None = None) -> DataFrame:
    """(check, failures) of a benchmark's structure; no failures means that the check holds.

    queries has query_id and the columns of by: a column's expected number of queries for each value. within = (column, value, like by) asks the same of the rows with
    that value. Failures count values whose number differs, unexpected ones included. Ids must be unique; qrels (query_id, grade) must name every
    query, no other, and each with grade 2. Null ids and values are values like others. The tables of expected numbers are small by nature."""

    def balance(rows: DataFrame, column: str, want: dict[str, int], name: str) -> DataFrame:
        expected = queries.sparkSession.createDataFrame([*want.items()], "_v string, _n long")
        have = rows.groupBy(F.col(column).cast("string").alias("_h")).agg(F.count("*").alias("_c"))
        both = have.join(F.broadcast(expected), F.col("_h").eqNullSafe(F.col("_v")), "full")
        return both.agg(F.count_if(~F.coalesce(F.col("_c") == F.col("_n"), F.lit(False))).alias("failures")).select(F.lit(name).alias("check"), "failures")

    out = [balance(queries, c, want, f"balance_{c}") for c, want in by.items()]
    if within:
        column, value, wants = within
        out += [balance(queries.where(F.col(column) == value), c, want, f"balance_{value}_{c}") for c, want in wants.items()]
    count = lambda rows, name: rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    ids = queries.groupBy("query_id").agg(F.count("*").alias("_c"))
    graded = qrels.groupBy(F.col("query_id").alias("_q")).agg(F.max("grade").alias("_g"))
    same = F.col("query_id").eqNullSafe(F.col("_q"))
    both = ids.withColumn("_a", F.lit(1)).join(graded.withColumn("_b", F.lit(1)), same, "full")
    out += [count(ids.where("_c > 1"), "unique_query_ids"), count(both.where("_b IS NULL"), "queries_without_qrels"), count(both.where("_a IS NULL"), "qrels_of_unknown_queries")]
    out.append(count(both.where("_a = 1 AND _b = 1 AND NOT coalesce(_g >= 2, false)"), "queries_without_grade_2"))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def resolve_qrels(qrels: DataFrame, chunks: DataFrame, places: list[str]) -> tuple[DataFrame, DataFrame]:
    """(grades, unresolved): qrels with the chunk_id at their place, and those whose place no chunk has, each once.

    A place is the columns of places, the same in both tables; null parts match nothing. Where several chunks share one, the last by chunk_index stands for it; qrels that
    repeat a query and chunk give the highest grade."""
    last = chunks.groupBy(*places).agg(F.max_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))
    hit = qrels.join(last, places, "left")
    grades = hit.where("chunk_id IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))
    return grades, hit.where("chunk_id IS NULL").select("query_id", *places).distinct()
