"""Queries over nested JSON records, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import variants
from vigil.plans.catalog import query
from vigil.sources.tables import table

#: Events as JSON whose depth follows their properties.
NESTED_SQL = """e AS (SELECT event_id, event_type AS t, floor(value)::BIGINT AS n, coalesce(props, '{}') AS p, coalesce((props::JSON->>'k')::INT, 0) AS k FROM events),
j AS (SELECT event_id, '{"type":"' || t || '","n":' || n || ',"ok":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"none":null,"tags":["' || t || '",[],{}],"deep":' || repeat('{"in":[0,', k % 6) || p || repeat(']}', k % 6) || '}' AS text FROM e),
w AS (SELECT event_id, substr(x.fullkey, 3) AS path, CASE x.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long' ELSE lower(x.type) END AS type, CASE WHEN x.type NOT IN ('OBJECT', 'ARRAY') THEN x.atom->>'$' END AS value
 FROM j, json_tree(j.text::JSON) x WHERE x.type NOT IN ('OBJECT', 'ARRAY') OR x.value::VARCHAR IN ('{}', '[]'))"""


def _events(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("t"), F.floor("value").cast("string").alias("n"), F.coalesce("props", F.lit("{}")).alias("p"), k.alias("k"))


def _leaves(spark, d):
    q = lambda s: F.lit(s)
    wrap = (F.col("k") % 6).cast("int")
    even = F.when(F.col("n").cast("long") % 2 == 0, "true").otherwise("false")
    text = F.concat(q('{"type":"'), "t", q('","n":'), "n", q(',"ok":'), even, q(',"none":null,"tags":["'), "t", q('",[],{}],"deep":'), F.repeat(q('{"in":[0,'), wrap), "p", F.repeat(q("]}"), wrap), q("}"))
    return variants.leaves(_events(spark, d).select("event_id", text.alias("text")), "event_id", "text")


@query(f"WITH {NESTED_SQL} SELECT * FROM w")
def json_leaves(spark, d):
    """Every leaf of nested records, with path and type."""
    return _leaves(spark, d)


@query(rf"""WITH {NESTED_SQL} SELECT event_id, regexp_replace(path, '\[([0-9]+)\]', '.\1', 'g') AS name, CASE type WHEN 'boolean' THEN (value = 'true')::INT::DOUBLE ELSE value::DOUBLE END AS value FROM w WHERE type IN ('long', 'double', 'boolean')""")
def scalar_measures(spark, d):
    """Numbers and truth values of nested records by dotted names."""
    return variants.scalar_measures(_leaves(spark, d), "event_id")


_LIST = "resourceLogs.scopeLogs.logRecords.body.kvlistValue.values.value.arrayValue.values."


@query(f"""WITH e AS (SELECT event_id, event_type AS t, floor(value)::BIGINT AS n, coalesce((props::JSON->>'k')::INT, 0) AS k FROM events) SELECT event_id, CASE WHEN k % 19 = 5 THEN 'no JSON' ELSE concat_ws(',', CASE WHEN k % 7 = 3 THEN 'extra' END, CASE WHEN n % 3 = 1 THEN '{_LIST}' || t END) END AS unknown FROM e""")
def strict_otlp(spark, d):
    """Log records whose bodies nest, some with fields that no message has, some cut off: the unknown paths of each."""
    q = lambda s: F.lit(s)
    k, n = F.col("k"), F.col("n").cast("long")
    field = F.when(n % 3 == 0, "stringValue").when(n % 3 == 1, F.col("t")).otherwise("intValue")
    text = F.concat(
        q('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'), "t", q('"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"1","body":{"kvlistValue":{"values":[{"key":"a","value":{"arrayValue":{"values":[{"arrayValue":{}},{"'),
        field, q('":"'), "n", q('"}]}}}]}},"attributes":[]}]}]}]'), F.when(k % 7 == 3, ',"extra":{}').otherwise(""), F.when(k % 19 == 5, "").otherwise("}"),
    )
    found = variants.leaves(_events(spark, d).select("event_id", text.alias("text")), "event_id", "text")
    unknown = F.col("unknown")
    return variants.unknown_fields(found, "event_id", variants.otlp_paths()).select("event_id", F.when(F.array_contains(unknown, ""), "no JSON").otherwise(F.array_join(unknown, ",")).alias("unknown"))


@query("""WITH e AS (SELECT event_id, event_type AS t, floor(value)::BIGINT AS n, coalesce(props, '{}') AS p FROM events) SELECT event_id, sha256('run|logs|{"a":' || n || ',"props":' || replace(p, ' ', '') || ',"z":[1,{"b":"' || t || '","y":true}]}') AS source_id FROM e""")
def canonical_records(spark, d):
    """Identities of records over canonical text, whatever the order of their fields and their blanks."""
    text = F.concat(F.lit('{ "z": [1, {"y": true, "b": "'), "t", F.lit('"}], "props": '), "p", F.lit(', "a": '), "n", F.lit(" }"))
    return _events(spark, d).select("event_id", F.sha2(F.concat_ws("|", F.lit("run"), F.lit("logs"), variants.canonical_json(text)), 256).alias("source_id"))
