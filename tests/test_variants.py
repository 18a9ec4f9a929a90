import json

from pyspark.sql import functions as F

from vigil.operators import variants as V


def walked(value, path=""):
    """Leaves by plain recursion."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in walked(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in walked(v, f"{path}[{i}]")]
    return [path]


DEEP = '{"a":' * 9 + '[[],{"b":[1,null,true,2.5,"x"]}]' + "}" * 9


def test_leaves_equal_plain_recursion(spark):
    texts = [DEEP, "[]", "{}", "7", '"only text"', "null", '{"a.b":{"c d":1},"e":[{"f":[]},{"f":[[[0]]]}]}', "[null]", '{"é":"ü 😀"}']
    rows = spark.createDataFrame([*enumerate(texts), (0, DEEP), (None, '{"k":1}')], "id int, text string").repartition(3)
    got = V.leaves(rows.withColumn("path", F.lit("own")), "id", "text").collect()
    want = sorted([(i, p) for i, t in enumerate(texts) for p in walked(json.loads(t))] + [(0, p) for p in walked(json.loads(DEEP))] + [(-1, "k")])
    assert sorted((-1 if r.id is None else r.id, r.path) for r in got) == want
    by = {(r.id, r.path): (r.type, r.value) for r in got}
    at = "a." * 8 + "a[1].b"
    assert [by[0, f"{at}[{i}]"] for i in range(5)] == [("long", "1"), ("null", None), ("boolean", "true"), ("decimal", "2.5"), ("string", "x")]
    assert by[1, ""] == ("array", None) and by[2, ""] == ("object", None) and by[3, ""] == ("long", "7") and by[8, "é"] == ("string", "ü 😀")


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(1, "{"), (2, '{"a":1,"a":2}'), (3, None), (4, "")], "id int, text string")
    got = {r.id: (r.path, r.type, r.value) for r in V.leaves(rows, "id", "text").collect()}
    assert got == {1: ("", "invalid", "{"), 2: ("", "invalid", '{"a":1,"a":2}'), 4: ("", "invalid", "")}
    assert V.leaves(rows.limit(0), "id", "text").count() == 0


def test_unknown_fields(spark):
    allowed = V.otlp_paths()
    attribute = lambda v: '{"resourceSpans":[{"resource":{"attributes":[{"key":"k","value":' + v + "}]}}]}"
    place = "resourceSpans.resource.attributes.value"
    cases = {
        attribute('{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"x","value":{"arrayValue":{"values":[]}}}]}}]}}'): [],
        attribute('{"arrayValue":{"values":[{"kvlistValue":{"values":[{"name":"x"}]}}]}}'): [f"{place}.arrayValue.values.kvlistValue.values.name"],
        attribute('{"text":"x","other":{}}'): [f"{place}.other", f"{place}.text"], '{"resourceSpans":[]}': [], "{}": [], '{"resourceSpans":5}': ["resourceSpans"], "[]": [""], "{": [""],
        '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"m","gauge":{"dataPoints":[{"asInt":"1","asInteger":1}]}}]}]}]}': ["resourceMetrics.scopeMetrics.metrics.gauge.dataPoints.asInteger"],
    }
    rows = spark.createDataFrame([*enumerate(cases)], "id int, text string")
    got = {r.id: r.unknown for r in V.unknown_fields(V.leaves(rows, "id", "text"), "id", allowed).collect()}
    assert got == dict(enumerate(cases.values()))


def test_canonical_text_and_measures(spark):
    a, b = '{ "b" : [1, {"y":true, "x":null}], "a": 1.50 }', '{"a":1.5,"b":[1,{"x":null,"y":true}]}'
    rows = spark.createDataFrame([(1, a), (2, b), (3, "{")], "id int, text string")
    assert [r.c for r in rows.select("id", V.canonical_json(F.col("text")).alias("c")).orderBy("id").collect()] == [b, b, None]
    got = {(r.name, r.value) for r in V.scalar_measures(V.leaves(rows, "id", "text"), "id").where("id = 1").collect()}
    assert got == {("a", 1.5), ("b.0", 1.0), ("b.1.y", 1.0)}


def test_leaves_are_one_stage_and_typed_as_variants(spark):
    """No table is written on the way, whatever the depth; numbers and odd texts get the type and value that Spark's variants have."""
    ints = ["0", "-0", "7", "-12", "999999999999999999", "9223372036854775807", "9223372036854775808", "-9223372036854775809", "1" + "0" * 37, "1" * 39, "1" * 400]
    parts = ["1.0", "1.50", "-0.0", "0.10", "0.00000001", "-0.000000100", "100.0", "1e3", "1E-7", "-2.5e300", "1e999", "0." + "1" * 38, "0." + "1" * 39, "123456789012345678901234567890.123456789", "15e-1", "0.0000000"]
    others = [r'"a\ud800b"', r'"😀"', '"é\\n"', "true", "false", "null", " [1] x", "1 2", "01", "1.", "nul", "﻿1", "{} {", '"open']
    rows = spark.createDataFrame([*enumerate(ints + parts + others)], "id int, text string")
    found = V.leaves(rows, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" not in plan and "MapInArrow" in plan
    v = F.try_parse_json("text")
    name = F.lower(F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0))
    kind = F.when(v.isNull(), "invalid").when(name == "void", "null").when(name == "bigint", "long").otherwise(name)
    plain = rows.where("text <> ' [1] x' and text <> '{} {'")
    want = {(r.id, r.t, r.w) for r in plain.select("id", kind.alias("t"), F.when(v.isNull(), F.col("text")).otherwise(v.cast("string")).alias("w")).collect()}
    got = {(r.id, r.type, r.value) for r in found.collect()}
    assert want <= got, want - got
    whole = {r.id: r.ok for r in rows.select("id", v.isNotNull().alias("ok")).collect()}
    assert all((t == "invalid") != whole[i] for i, t, _ in got) and len(got) == len(ints + parts + others)
    deep = "[" * 900 + "5" + "]" * 900
    assert [tuple(r) for r in V.leaves(spark.createDataFrame([(1, deep)], "id int, text string"), "id", "text").collect()] == [(1, "[0]" * 900, "long", "5")]
