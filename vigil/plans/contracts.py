"""Queries over contracts of messages and the structure of benchmarks, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import contracts
from vigil.plans.catalog import query
from vigil.sources.tables import table

_LINE = contracts._record({
    "line": {"type": "integer", "minimum": 1, "exclusiveMaximum": 4}, "quantity": {"type": "number", "maximum": 45, "exclusiveMinimum": 2}, "tax": {"type": "number", "maximum": 0.07},
    "flag": {"enum": ["A", "N"]}, "status": {"const": "O"}, "part": {"type": "string", "minLength": 2, "maxLength": 3},
})
#: What an order should be; many aren't.
_ORDER = contracts._record({
    "order": {"type": "integer"}, "status": {"enum": ["F", "O"]}, "priority": {"type": "string", "pattern": "^[1-3]-[A-Z]+$"}, "price": {"type": "number", "maximum": 300000},
    "lines": {"type": "array", "minItems": 2, "maxItems": 6, "items": _LINE},
})


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
n AS (SELECT o_orderkey, count(l_orderkey) AS c FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
e AS (SELECT o_orderkey, '$.status: enum' AS e FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, '$.priority: pattern' FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$')
 UNION ALL SELECT o_orderkey, '$.priority: required' FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT o_orderkey, '$.price: maximum' FROM orders WHERE o_totalprice > 300000
 UNION ALL SELECT o_orderkey, '$.segment: additionalProperties' FROM orders WHERE o_custkey % 4 = 1 UNION ALL SELECT o_orderkey, '$.lines: minItems' FROM n WHERE c < 2 UNION ALL SELECT o_orderkey, '$.lines: maxItems' FROM n WHERE c > 6
 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].line: exclusiveMaximum' FROM l WHERE l_linenumber >= 4 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].quantity: maximum' FROM l WHERE l_quantity > 45 AND l_returnflag <> 'R'
 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].quantity: exclusiveMinimum' FROM l WHERE l_quantity <= 2 AND l_returnflag <> 'R' UNION ALL SELECT l_orderkey, '$.lines[' || i || '].quantity: type' FROM l WHERE l_returnflag = 'R'
 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].tax: maximum' FROM l WHERE l_tax > 0.07::DOUBLE UNION ALL SELECT l_orderkey, '$.lines[' || i || '].flag: enum' FROM l WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, '$.lines[' || i || '].status: const' FROM l WHERE l_linestatus <> 'O'
 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].part: minLength' FROM l WHERE l_partkey < 10 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].part: maxLength' FROM l WHERE l_partkey >= 1000)
SELECT o.o_orderkey, count(e) AS n_errors, coalesce(string_agg(e, ',' ORDER BY e), '') AS errors FROM orders o LEFT JOIN e ON e.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def order_contract(spark, d):
    """Orders with their lines as JSON messages, checked against a nested contract: every failure of every message. One order's lines, which are few, meet in a message."""
    li = table(spark, d, "lineitem")
    quantity = F.when(F.col("l_returnflag") == "R", F.concat(F.lit('"'), F.col("l_quantity").cast("string"), F.lit('"'))).otherwise(F.col("l_quantity").cast("string"))
    line = F.concat(F.lit('{"line":'), F.col("l_linenumber").cast("string"), F.lit(',"quantity":'), quantity, F.lit(',"tax":'), F.col("l_tax").cast("string"), F.lit(',"flag":"'), "l_returnflag", F.lit('","status":"'), "l_linestatus", F.lit('","part":"'), F.col("l_partkey").cast("string"), F.lit('"}'))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", line.alias("_line")))).alias("_lines"))
    joined = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    text = F.concat(
        F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", '"').otherwise(F.concat(F.lit('","priority":"'), "o_orderpriority", F.lit('"'))),
        F.when(F.col("o_custkey") % 4 == 1, ',"segment":null').otherwise(""), F.lit(',"price":'), F.col("o_totalprice").cast("string"), F.lit(',"lines":['), F.coalesce(F.array_join(F.transform("_lines", lambda x: x["_line"]), ","), F.lit("")), F.lit("]}"),
    )
    e = joined.select("o_orderkey", contracts.schema_errors(_ORDER, text).alias("e"))
    return e.select("o_orderkey", F.size("e").cast("long").alias("n_errors"), F.array_join("e", ",").alias("errors"))


@query("""WITH r AS (SELECT event_id, event_type AS t, floor(value)::BIGINT AS v, (props::JSON->>'k')::INT AS k, user_id % 10 AS u, ts, props FROM events), e AS (
 SELECT event_id, '$.event_id: pattern' AS e FROM r WHERE v % 5 = 0 UNION ALL SELECT event_id, '$.signal: enum' FROM r WHERE t IN ('signup', 'purchase') UNION ALL SELECT event_id, '$.source.offset: minimum' FROM r WHERE v < 60
 UNION ALL SELECT event_id, '$.source.partition: type' FROM r WHERE k % 8 = 7 UNION ALL SELECT event_id, '$.service_names: uniqueItems' FROM r WHERE k % 10 = u UNION ALL SELECT event_id, '$.service_names[1]: minLength' FROM r WHERE k % 10 <> u AND v % 4 = 3
 UNION ALL SELECT event_id, '$.produced_at_utc: format' FROM r WHERE extract(day FROM ts) > 28 UNION ALL SELECT event_id, '$.ground_truth.label: type' FROM r WHERE t = 'error' UNION ALL SELECT event_id, '$.ground_truth.scenario: required' FROM r WHERE t = 'view' UNION ALL SELECT event_id, '$.payload: type' FROM r WHERE props IS NULL OR k % 9 = 4)
SELECT r.event_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS errors FROM r LEFT JOIN e ON e.event_id = r.event_id GROUP BY r.event_id""")
def outgoing_contract(spark, d):
    """Outgoing events whose fields follow from a row's type, value, time and properties, against the fixed contract: all failures of each. Days past the 28th are written as of February."""
    q, v, k, u = F.lit, F.floor("value"), F.get_json_object("props", "$.k").cast("int"), F.col("user_id") % 10
    t, i = F.col("event_type"), F.col("event_id").cast("string")
    signal = F.when(t == "click", "metrics").when(t == "view", "logs").when(t == "error", "traces").otherwise(t)
    sha = F.sha2(i, 256)
    day = F.when(F.dayofmonth("ts") > 28, q("2023-02-29")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    other = F.when(k % 10 == u, F.concat(q("svc-"), u.cast("string"))).when(v % 4 == 3, "").otherwise("gateway")
    text = F.concat(
        q('{"schema_version":1.0,"event_id":"'), F.when(v % 5 == 0, F.upper(F.concat(q("a"), F.substring(sha, 2, 63)))).otherwise(sha), q('","event_type":"telemetry.processed","produced_at_utc":"'), day, F.date_format("ts", "'T'HH:mm:ss.SSS'Z'"), q('","signal":"'), signal,
        q('","source":{"topic":"telemetry.raw","partition":'), F.when(k % 8 == 7, q("0.5")).otherwise(F.coalesce((k % 4).cast("string"), q("0"))), q(',"offset":'), (v - 60).cast("string"), q('},"service_names":["svc-'), u.cast("string"), q('","'), other, q('"],"ground_truth":{"run_id":null,'),
        F.when(t == "view", q("")).otherwise('"scenario":"load",'), q('"label":'), F.when(t == "error", F.floor("value").cast("string")).otherwise('"none"'), q('},"payload":'), F.when(k % 9 == 4, q("[1]")).otherwise(F.coalesce("props", q("null"))), q("}"),
    )
    e = contracts.schema_errors(contracts.PROCESSED_EVENT, text)
    return table(spark, d, "events").select("event_id", F.array_join(e, ",").alias("errors"))


@query("""WITH w AS (SELECT user_id, event_id, floor(value)::BIGINT AS v, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL), e AS (
 SELECT user_id, '$.windows[' || i || '].values: minItems' AS e FROM w WHERE t = 'error' UNION ALL SELECT user_id, '$.windows[' || i || '].values[1]: type' FROM w WHERE t = 'view' UNION ALL SELECT user_id, '$.windows[' || i || ']: window_order' FROM w WHERE v % 7 = 0
 UNION ALL SELECT user_id, '$.windows: window_id' FROM w GROUP BY user_id HAVING count(DISTINCT v) < count(*) UNION ALL SELECT user_id, '$.windows: maxItems' FROM w GROUP BY user_id HAVING count(*) > 12 UNION ALL SELECT user_id, '$.feature_names: const' FROM w GROUP BY user_id HAVING min(v) % 2 = 1)
SELECT u.user_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS errors FROM (SELECT DISTINCT user_id FROM w) u LEFT JOIN e ON e.user_id = u.user_id GROUP BY u.user_id""")
def request_contract(spark, d):
    """A scoring request for each user with a window for each event: names in order, widths, finite values, unique ids and ends after starts. A request is one message, so its windows meet."""
    q, v = F.lit, F.floor("value")
    g = table(spark, d, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("_ws"), F.min(v).alias("_v"))

    def window(x):
        v, t = F.floor(x["value"]), x["event_type"]
        values = F.when(t == "error", q("[1.5]")).when(t == "view", q('[1,"NaN"]')).otherwise(F.concat(q("["), x["value"].cast("string"), q(",null]")))
        end = F.when(v % 7 == 0, q("00:00:00")).otherwise("00:00:10")
        return F.concat(q('{"window_id":"w'), v.cast("string"), q('","service_name":"svc","window_start_utc":"2024-01-01T00:00:00Z","window_end_utc":"2024-01-01T'), end, q('Z","values":'), values, q("}"))

    names = F.when(F.col("_v") % 2 == 1, q('["b","a"]')).otherwise('["a","b"]')
    text = F.concat(q('{"schema_version":"ml_inference_v1","feature_schema_version":1,"input_id":"'), F.col("user_id").cast("string"), q('","feature_names":'), names, q(',"windows":['), F.array_join(F.transform("_ws", window), ","), q("]}"))
    return g.select("user_id", F.array_join(contracts.request_errors(["a", "b"], text, 12), ",").alias("errors"))


_TYPES, _SPLITS = {"ECONOMY": 40, "STANDARD": 40, "PROMO": 40}, {"development": 120, "test": 80}


def _balance_sql(rows: str, column: str, want: dict[str, int], name: str) -> str:
    values = ", ".join(f"('{v}', {n})" for v, n in want.items())
    return f"SELECT '{name}' AS \"check\", count(*) FILTER (c IS DISTINCT FROM n) AS failures FROM (SELECT {column} AS h, count(*) AS c FROM {rows} GROUP BY 1) FULL JOIN (VALUES {values}) x(v, n) ON h = v"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, p_type AS incident_type, CASE WHEN p_size <= 30 THEN 'development' ELSE 'test' END AS split FROM part), g AS (SELECT l_partkey + CASE WHEN l_quantity = 50 THEN 1000000 ELSE 0 END AS query_id, CASE WHEN l_discount >= 0.1::DOUBLE AND l_tax > 0.05::DOUBLE THEN 2 ELSE 1 END AS grade FROM lineitem),
h AS (SELECT query_id, max(grade) AS m FROM g GROUP BY 1) {_balance_sql("q", "incident_type", _TYPES, "balance_incident_type")} UNION ALL {_balance_sql("q", "split", _SPLITS, "balance_split")}
 UNION ALL {_balance_sql("(SELECT * FROM q WHERE split = 'test')", "incident_type", {k: 16 for k in _TYPES}, "balance_test_incident_type")}
 UNION ALL SELECT 'unique_query_ids', count(*) FROM (SELECT query_id FROM q GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'queries_without_qrels', count(*) FROM (SELECT DISTINCT query_id FROM q) WHERE query_id NOT IN (SELECT query_id FROM h)
 UNION ALL SELECT 'qrels_of_unknown_queries', count(*) FROM h WHERE query_id NOT IN (SELECT query_id FROM q) UNION ALL SELECT 'queries_without_grade_2', count(*) FROM h WHERE m < 2 AND query_id IN (SELECT query_id FROM q)""")
def benchmark_structure(spark, d):
    """Balance, unique ids and coverage of a benchmark; parts stand for queries and lines for grades."""
    queries = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("incident_type"), F.when(F.col("p_size") <= 30, "development").otherwise("test").alias("split"))
    li = table(spark, d, "lineitem")
    qrels = li.select((F.col("l_partkey") + F.when(F.col("l_quantity") == 50, 1000000).otherwise(0)).alias("query_id"), F.when((F.col("l_discount") >= 0.1) & (F.col("l_tax") > 0.05), 2).otherwise(1).alias("grade"))
    return contracts.structure_checks(queries, qrels, {"incident_type": _TYPES, "split": _SPLITS}, ("split", "test", {"incident_type": {k: 16 for k in _TYPES}}))


_QRELS_SQL = """c AS (SELECT 'part-' || p_partkey AS chunk_id, p_brand || '/' || p_size // 2 AS source_path, p_type AS heading_path, p_partkey AS chunk_index FROM part WHERE p_retailprice > 905),
g AS (SELECT l_suppkey AS query_id, p_brand || '/' || p_size // 2 AS source_path, p_type AS heading_path, CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS grade FROM lineitem JOIN part ON p_partkey = l_partkey),
h AS (SELECT g.*, m.chunk_id FROM g LEFT JOIN (SELECT source_path, heading_path, arg_max(chunk_id, chunk_index) AS chunk_id FROM c GROUP BY 1, 2) m USING (source_path, heading_path))"""


def _resolved(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.floor(F.col("p_size") / 2).cast("string")).alias("source_path"), F.col("p_type").alias("heading_path"), "p_retailprice")
    chunks = p.where("p_retailprice > 905").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("chunk_id"), "source_path", "heading_path", F.col("p_partkey").alias("chunk_index"))
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("query_id"), F.when(F.col("l_quantity") > 40, 2).otherwise(1).alias("grade"))
    qrels = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("query_id", "source_path", "heading_path", "grade")
    return contracts.resolve_qrels(qrels, chunks, ["source_path", "heading_path"])


@query(f"WITH {_QRELS_SQL} SELECT query_id, chunk_id, max(grade) AS grade FROM h WHERE chunk_id IS NOT NULL GROUP BY 1, 2")
def resolved_grades(spark, d):
    """Grades given to places, as grades of the chunks there."""
    return _resolved(spark, d)[0]


@query(f"WITH {_QRELS_SQL} SELECT DISTINCT query_id, source_path, heading_path FROM h WHERE chunk_id IS NULL")
def unresolved_qrels(spark, d):
    """Grades whose place no chunk has."""
    return _resolved(spark, d)[1]
