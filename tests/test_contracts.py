import json
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.operators import contracts as C


def kinds(v):
    if v is None or isinstance(v, bool):
        return {"null"} if v is None else {"boolean"}
    if isinstance(v, (int, float)):
        return {"number", "integer"} if float(v).is_integer() else {"number"}
    return {"string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"}


def same(a, b):
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def plain(schema, v, at="$"):
    """Failures by plain recursion."""
    out, k = [], kinds(v)
    fail = lambda w, at=at: out.append(f"{at}: {w}")
    if schema is True:
        return out
    if schema is False:
        return [f"{at}: never"]
    types = schema.get("type")
    if types is not None and not k & set([types] if isinstance(types, str) else types):
        fail("type")
    if "const" in schema and not same(v, schema["const"]):
        fail("const")
    if "enum" in schema and not any(same(v, x) for x in schema["enum"]):
        fail("enum")
    tests = {
        "number": {"minimum": lambda b: v < b, "maximum": lambda b: v > b, "exclusiveMinimum": lambda b: v <= b, "exclusiveMaximum": lambda b: v >= b},
        "string": {"minLength": lambda b: len(v) < b, "maxLength": lambda b: len(v) > b, "pattern": lambda b: not re.search(b, v)},
        "array": {"minItems": lambda b: len(v) < b, "maxItems": lambda b: len(v) > b, "uniqueItems": lambda b: b and any(same(x, y) for i, x in enumerate(v) for y in v[:i])},
        "object": {"minProperties": lambda b: len(v) < b, "maxProperties": lambda b: len(v) > b},
    }
    for name, words in tests.items():
        if name in k:
            for w, bad in words.items():
                if w in schema and bad(schema[w]):
                    fail(w)
    if "object" in k:
        for n in schema.get("required", []):
            if n not in v:
                fail("required", f"{at}.{n}")
        for n, x in v.items():
            if n in schema.get("properties", {}):
                out += plain(schema["properties"][n], x, f"{at}.{n}")
            elif schema.get("additionalProperties", True) is False:
                fail("additionalProperties", f"{at}.{n}")
            else:
                out += plain(schema.get("additionalProperties", True), x, f"{at}.{n}")
    if "array" in k:
        for i, x in enumerate(v):
            out += plain(schema.get("items", True), x, f"{at}[{i}]")
    return sorted(out)


def made(r, depth=0):
    pick = r.random()
    if depth < 4 and pick < 0.3:
        return {n: made(r, depth + 1) for n in r.sample(["a", "b c", "d'", "e"], r.randint(0, 4))}
    if depth < 4 and pick < 0.5:
        return [made(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, 0, 1, 1.0, 2, -3, 2.5, 10**17, "", "x", "xyz", "é😀", "12"])


_INNER = {"type": ["number", "null", "string"], "minimum": 0, "exclusiveMaximum": 2.5, "minLength": 1, "maxLength": 2, "pattern": r"^\D"}
SCHEMAS = [
    {"type": "object", "required": ["a", "b c"], "properties": {"a": _INNER, "b c": {"type": "array", "items": _INNER, "uniqueItems": True, "maxItems": 3}, "d'": {"const": 1}}, "additionalProperties": False, "maxProperties": 3},
    {"additionalProperties": {"enum": [1, None, "x", True]}, "items": {"items": {"type": "integer"}, "additionalProperties": {"type": "boolean"}, "minItems": 2}, "minProperties": 1, "properties": {"e": False}},
    {"const": {"a": 1, "e": [2.5, "é"]}, "description": "a note"}, {"properties": {"a": {"properties": {"a": {"items": {"required": ["e"]}}}}}, "exclusiveMinimum": 1, "maximum": 2, "items": True}, {},
]


def test_errors_equal_plain_recursion(spark):
    r = random.Random(5)
    docs = [made(r) for _ in range(250)] + [{"a": 1, "e": [2.5, "é"]}, {"e": [2.5, "é"], "a": 1.0}, {}, [], [1, 1.0], [[1, 1], [True]], {"a": {"a": [{"e": 1}, {}]}}]
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "i int, t string").repartition(3)
    for schema in SCHEMAS:
        got = {x.i: x.e for x in rows.select("i", C.schema_errors(schema, rows["t"]).alias("e")).collect()}
        for i, d in enumerate(docs):
            assert got[i] == plain(schema, d), (schema, d)


def test_contracts_and_texts_that_are_no_json(spark):
    good = {"schema_version": 1, "event_type": "telemetry.dlq", "failed_at_utc": "2024-02-29T23:59:59.5+05:30", "source": {"topic": "t", "partition": 0, "offset": 9}, "headers": {"a": None, "b": "x"},
            "error": {"category": "invalid_json", "message": "m"}, "processing_attempt_count": 1, "raw_payload": {"encoding": "base64", "data": ""}, "ground_truth": {"run_id": None, "scenario": "s", "label": None}}
    bad = good | {"headers": {"a": 1}, "failed_at_utc": "2023-02-29T00:00:00Z", "processing_attempt_count": 0, "raw_payload": {"encoding": "hex"}, "more": 1}
    texts = [json.dumps(good), json.dumps(bad), None, "", "{", '{"a":1,"a":2}', "7", json.dumps(good | {"failed_at_utc": "2024-01-01T00:00:00Z\n"})]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    got = [x.e for x in rows.select("i", C.schema_errors(C.DEAD_LETTER, rows["t"]).alias("e")).orderBy("i").collect()]
    assert got[0] == [] and got[2:6] == [["$: json"]] * 4 and got[6] == ["$: type"] and got[7] == ["$.failed_at_utc: format"]
    assert got[1] == ["$.failed_at_utc: format", "$.headers.a: type", "$.more: additionalProperties", "$.processing_attempt_count: minimum", "$.raw_payload.data: required", "$.raw_payload.encoding: const"]
    assert rows.limit(0).select(C.schema_errors(C.DEAD_LETTER, rows["t"])).count() == 0
    with pytest.raises(ValueError, match="multipleOf"):
        C.schema_errors({"items": {"multipleOf": 2}}, rows["t"])


def test_records_of_a_benchmark(spark):
    q = {"query_id": "q", "query": "x", "incident_type": "i", "style": "s", "split": "test"}
    g = {"query_id": "q", "source_path": "p", "heading_path": ["h"], "grade": 2}
    cases = [(C.QUERY_RECORD, q, []), (C.QUERY_RECORD, q | {"style": " \t", "x": 1}, ["$.style: pattern", "$.x: additionalProperties"]), (C.QREL_RECORD, g, []),
             (C.QREL_RECORD, g | {"heading_path": [], "grade": 3}, ["$.grade: enum", "$.heading_path: minItems"]), (C.QREL_RECORD, g | {"heading_path": ["a", ""]}, ["$.heading_path[1]: minLength"])]
    for schema, doc, want in cases:
        rows = spark.createDataFrame([(json.dumps(doc),)], "t string")
        assert rows.select(C.schema_errors(schema, rows["t"])).first()[0] == want


def test_structure_and_places(spark):
    queries = spark.createDataFrame([("a", "x", "test"), ("b", "y", "test"), ("b", "y", "dev"), (None, None, "dev")], "query_id string, kind string, split string")
    qrels = spark.createDataFrame([("a", 2), ("b", 1), ("z", 2), ("z", 1)], "query_id string, grade int")
    got = {r.check: r.failures for r in C.structure_checks(queries, qrels, {"kind": {"x": 1, "y": 1, "w": 1}}, ("split", "test", {"kind": {"x": 1, "y": 1}})).collect()}
    assert got == {"balance_kind": 3, "balance_test_kind": 0, "unique_query_ids": 1, "queries_without_qrels": 1, "qrels_of_unknown_queries": 1, "queries_without_grade_2": 1}
    chunks = spark.createDataFrame([("c1", "p", "h", 0), ("c2", "p", "h", 1), ("c3", None, "h", 0)], "chunk_id string, path string, heading string, chunk_index int")
    asked = spark.createDataFrame([("a", "p", "h", 1), ("a", "p", "h", 2), ("a", None, "h", 1), ("b", "p", "no", 1), ("b", "p", "no", 2)], "query_id string, path string, heading string, grade int")
    grades, missing = C.resolve_qrels(asked, chunks, ["path", "heading"])
    assert [tuple(r) for r in grades.collect()] == [("a", "c2", 2)]
    assert sorted((r.query_id, r.path or "", r.heading) for r in missing.collect()) == [("a", "", "h"), ("b", "p", "no")]


def test_numbers_as_written_and_deep_values(spark):
    """Whole numbers of any size are integers, decimals that differ after the digits of a double differ, and a value may lie deep."""
    unique, deep = {"items": {"type": "integer"}, "uniqueItems": True}, "[" * 900 + "]" * 900
    cases = [({"type": "integer"}, "18446744073709551616", []), ({"type": "integer"}, "-1e19", []), ({"type": "integer"}, "1e999", ["$: type"]), ({"type": "integer", "maximum": 9}, " 10.0 x", ["$: maximum"]),
             (unique, "[1, 1.0]", ["$: uniqueItems"]), ({"const": [1.5]}, "[1.50]", []), ({"const": [0.5]}, "[0.50000000000000000000001]", ["$: const"]), ({"enum": [[1], "x"]}, '"y"', ["$: enum"]), ({"const": [[]]}, deep, ["$: const"]),
             ({"enum": ["a", {"b": None}]}, '{"b":null}', []), ({"maxLength": 1, "pattern": r"^\p{Lu}"}, '"\\u00c9"', []), ({"additionalProperties": False}, '{"b":1,"a":[]}', ["$.a: additionalProperties", "$.b: additionalProperties"])]
    for schema, text, want in cases:
        rows = spark.createDataFrame([(text,)], "t string").repartition(1)
        assert rows.select(C.schema_errors(schema, rows["t"])).first()[0] == want, (schema, text[:40])


def test_a_message_is_read_once_outside_functions_of_higher_order(spark):
    rows = spark.createDataFrame([("{}",)], "t string")
    plan = rows.select(C.schema_errors(C.QUERY_RECORD, rows["t"]).alias("e")).selectExpr("size(e)", "array_join(e, ',')")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("pythonUDF1") == 0 and "variantget" not in plan.lower().replace("_", "")


def request(windows):
    return {"schema_version": "ml_inference_v1", "feature_schema_version": 1, "input_id": "i", "feature_names": ["a", "b"], "windows": windows}


def window(i, start="2024-01-01T00:00:00Z", end="2024-01-01T00:00:10Z"):
    return {"window_id": i, "service_name": "s", "window_start_utc": start, "window_end_utc": end, "values": [1.5, None]}


def batch(messages, n):
    text = json.dumps(request([window(f"w{i}") for i in range(n)])).encode()
    return pa.array([text] * messages, pa.binary()), pa.array([True] * messages)


def test_a_task_opens_a_part_of_its_batch():
    """What a task holds doesn't grow with the bytes of a batch, and plain times leave no question for each window."""
    peaks = []
    for messages in (64, 320):  # of some 60 kB
        given = batch(messages, 400)
        tracemalloc.start()
        answers = sum((list(map(len, part.to_pylist())) for part in C._found(C.inference_request(["a", "b"]))(iter([given]))), [])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert answers == [1] * messages  # the names
    assert peaks[1] < 2 * peaks[0], peaks


def test_parts_of_a_batch_keep_its_rows(monkeypatch):
    monkeypatch.setattr(C, "_OPENED", 20)
    texts = [None, b"1", b"2" * 50, b'"x"', b"3" * 12, b"4" * 8, b"", b"5" * 21]
    parts = [x.to_pylist() for x, _ in C._slices(pa.array(texts, pa.binary()), pa.array([x is not None for x in texts]))]
    assert sum(parts, []) == texts and all(len(x) == 1 or sum(len(t or b"") for t in x) <= 20 for x in parts) and len(parts) == 5
    assert [(len(x), len(ok)) for x, ok in C._slices(pa.array([], pa.binary()), pa.array([], pa.bool_()))] == [(0, 0)]


def test_date_times_are_those_that_spark_reads(spark):
    r = random.Random(2)
    texts = ["%04d-%02d-%02dT%02d:%02d:%02d%s" % (r.choice([0, 4, 100, 1582, 1900, 2000, 2023, 2024, 9999]), r.choice([0, 1, 2, 2, 4, 12, 13]), r.choice([0, 1, 28, 29, 30, 31, 32]), r.choice([0, 23, 24]), r.choice([0, 59, 60]), r.choice([0, 59, 60]), r.choice(["Z", "z", ".5Z", "+23:59", "+24:00", ""])) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "2024-02-29T00:00:00Z", "2024-01-01T00:00:00Z\n", "٢٠٢٤-01-01T00:00:00Z", "12024-01-01T00:00:00Z", "2024-01-01t00:00:00.Z"]], "t string")
    form = F.rlike("t", F.lit(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)\z"))
    read = F.try_to_timestamp(F.concat(F.substring("t", 1, 10), F.lit(" "), F.substring("t", 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    got = [(x.t, x.ok) for x in rows.select("t", (form & read).alias("ok")).collect()]
    assert {ok for _, ok in got} == {True, False} and [x for x in got if C._real(x[0]) != x[1]] == []


def test_windows_of_requests(spark):
    """Ids and times are compared as Spark casts them."""
    same, order = ["$.windows: window_id"], ["$.windows[0]: window_order"]
    early, late = "2024-01-01T00:00:00Z", "2024-01-01T00:00:10Z"
    cases = [([window("a"), window("b")], []), ([window("a"), window("a")], same), ([window("\ud800"), window("?")], same), ([window("a", late, early)], order), ([window("a", early, early)], order),
             ([window("a", "2024-01-01T00:00:10.5Z", "2024-01-01T00:00:10.50Z")], order), ([window("a", "2024-01-01T00:00:10.5Z", "2024-01-01T00:00:10.500001Z")], []), ([window("a", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00-00:00")], order),
             ([window("a", "2024-01-01T00:00:00+02:00", "2023-12-31T23:00:00Z")], []), ([window("a", late, "2024-01-01T05:00:00+05:00")], order), ([window("a", late, "2023-02-29T00:00:00Z")], ["$.windows[0].window_end_utc: format"]),
             ([window("a", late, "2024")], ["$.windows[0].window_end_utc: format", *order]), ([window("a", late, 2024)], ["$.windows[0].window_end_utc: type", *order])]
    cases += [([window(1), window("1")], [*same, "$.windows[0].window_id: type"]), ([window(1.0), window(True)], ["$.windows[0].window_id: type", "$.windows[1].window_id: type"]), ([None, 3], [*same, "$.windows[0]: type", "$.windows[1]: type"]), ({}, ["$.windows: type"]), ([], ["$.windows: minItems"])]
    rows = spark.createDataFrame([(i, json.dumps(request(w))) for i, (w, _) in enumerate(cases)] + [(len(cases), "{"), (len(cases) + 1, None), (len(cases) + 2, "[]")], "i int, t string")
    got = [x.e for x in rows.select("i", C.request_errors(["a", "b"], rows["t"]).alias("e")).orderBy("i").collect()]
    assert got == [want for _, want in cases] + [["$: json"], ["$: json"], ["$: type"]]
