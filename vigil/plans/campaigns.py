"""Queries over manifests, catalogs, campaigns, captures, analysis runs and written datasets, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import campaigns
from vigil.plans.catalog import query
from vigil.sources.tables import folder, table

_GOOD = '{"schema_version":1,"run_id":"@","scenario":"cart","label":"cart","validation_status":"PASS","duration_seconds":60,"signals":{"metrics":"metrics.jsonl","logs":"logs.jsonl","traces":"traces.jsonl"},"feature_flag":{"restored":true}}'
#: Manifests by rule, and the rule that each breaks; @ stands for the run.
_MANIFESTS = (
    (_GOOD, "valid"), ("{", "invalid_json"), ('{"schema_version":1,"run_id":"@"}', "missing_fields"), (_GOOD.replace(":1,", ":2,", 1), "unsupported_version"), (_GOOD.replace("@", "x@"), "run_id_mismatch"), (_GOOD.replace('"scenario":"cart"', '"scenario":"?"'), "unknown_scenario"),
    (_GOOD.replace('"label":"cart"', '"label":"c"'), "label_mismatch"), (_GOOD.replace("PASS", "FAIL"), "not_passed"), (_GOOD.replace(":60", ":0"), "invalid_duration"), (_GOOD.replace("logs.jsonl", "l"), "signal_file_mismatch"), (_GOOD.replace("cart", "normal"), "unexpected_flag"), (_GOOD.replace("true", "false"), "flag_not_restored"),
)


@query(f"SELECT o_orderkey, {[e for _, e in _MANIFESTS]}[(o_custkey % 12 + 1)::INT] AS verdict FROM orders")
def manifest_checks(spark, d):
    """Manifests of runs, by rule one of twelve, with the first rule that they break."""
    run = F.col("o_orderkey").cast("string")
    text = F.replace(F.element_at(F.array(*(F.lit(m) for m, _ in _MANIFESTS)), (F.col("o_custkey") % 12 + 1).cast("int")), F.lit("@"), run)
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(campaigns.manifest_error(text, run, ["normal", "cart"]), F.lit("valid")).alias("verdict"))


@query("""WITH s AS (SELECT CASE WHEN p_partkey % 20 = 7 THEN 'part-' || (p_partkey + 1) ELSE 'part-' || p_partkey END AS name, CASE WHEN p_partkey % 31 = 0 THEN '' ELSE 'l' END AS label, CASE WHEN p_partkey % 3 > 0 THEN 'flag-' || (p_partkey // 4) END AS flag, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'on' END AS variant, CASE WHEN p_partkey % 25 = 1 THEN 'b' ELSE 'a' END AS baseline FROM part),
g AS (SELECT name, count(*) AS n, max((label = '')::INT) AS b, max((flag IS NOT NULL AND variant IS NULL)::INT) AS p FROM s GROUP BY name)
SELECT name, 'blank_field' AS error FROM g WHERE b = 1 UNION ALL SELECT name, 'duplicate_name' FROM g WHERE n > 1 UNION ALL SELECT name, 'incomplete_flag' FROM g WHERE p = 1
UNION ALL SELECT DISTINCT name, 'conflicting_baseline' FROM s WHERE flag IN (SELECT flag FROM s WHERE flag IS NOT NULL GROUP BY flag HAVING count(DISTINCT baseline) > 1) UNION ALL SELECT NULL, 'normal_missing'""")
def catalog_checks(spark, d):
    """Parts as scenarios, some broken by rule; none is the normal one."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("part-"), F.when(k % 20 == 7, k + 1).otherwise(k).cast("string"))
    s = table(spark, d, "part").select(
        name.alias("name"), F.when(k % 31 == 0, "").otherwise("l").alias("label"), F.lit("d").alias("description"), F.when(k % 3 > 0, F.concat(F.lit("flag-"), F.floor(k / 4).cast("string"))).alias("flag"),
        F.when(k % 17 == 0, None).otherwise("on").alias("variant"), F.when(k % 25 == 1, "b").otherwise("a").alias("baseline"),
    )
    return campaigns.catalog_errors(s)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS s FROM orders), r AS (SELECT s, count(*) + (s LIKE '4%')::INT AS runs FROM o WHERE o_orderkey % 3 = 0 AND s NOT LIKE '5%' GROUP BY s), q AS (SELECT s, count(*) AS n FROM o WHERE o_orderkey % 3 = 0 GROUP BY s),
e AS (SELECT s, count(*) AS n, count(*) FILTER (c > 1) AS twice FROM (SELECT s, count(*) OVER (PARTITION BY run) AS c FROM (SELECT s, CASE WHEN s LIKE '1%' THEN o_custkey ELSE -o_orderkey END AS run FROM o WHERE o_orderkey % 7 = 0 OR s LIKE '2%')) GROUP BY s)
SELECT s AS scenario, coalesce(runs, 0) AS required, coalesce(q.n, 0) AS ordered, coalesce(e.n, 0) AS existing, CASE WHEN runs IS NULL THEN 'unknown_scenario' WHEN runs <> coalesce(q.n, 0) THEN 'order_mismatch' WHEN twice > 0 THEN 'duplicate_existing' WHEN e.n > runs THEN 'over_quota' END AS error FROM r FULL JOIN q USING (s) FULL JOIN e USING (s)""")
def campaign_checks(spark, d):
    """Orders as runs of a campaign by priority; requirements, order and accepted runs by rule."""
    s, k = F.col("o_orderpriority"), F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", s.alias("scenario"))
    third = o.where(k % 3 == 0)
    required = third.where("scenario not like '5%'").groupBy("scenario").agg(F.count("*").alias("n")).select("scenario", (F.col("n") + F.col("scenario").startswith("4").cast("int")).alias("runs"))
    existing = o.where((k % 7 == 0) | F.col("scenario").startswith("2")).select(F.when(F.col("scenario").startswith("1"), F.col("o_custkey")).otherwise(-k).alias("run_id"), "scenario")
    return campaigns.campaign_errors(required, third.select("scenario"), existing)


_CAPTURE_SQL = """c AS (SELECT strftime(ts, '%Y%m%d') AS run_id, ['metrics','logs','traces'][(event_id % 3 + 1)::INT] AS signal, event_id % 211 = 0 AS broken, CASE WHEN event_id % 5 > 0 AND event_id % 211 > 0 THEN 'svc-' || (user_id % 10) END AS s FROM events WHERE event_id % 13 > 0)"""


def _capture(spark, d):
    i = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % 3 + 1).cast("int"))
    name = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")))
    root = pick("resourceMetrics", "resourceLogs", "resourceSpans")
    whole = F.concat(F.lit('{"'), root, F.lit('":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'), name, F.lit('"}}]}}]}'))
    line = F.when(i % 13 == 0, " ").when(i % 211 == 0, F.concat(F.lit('{"'), root, F.lit('":{}}'))).otherwise(whole)
    return campaigns.capture_counts(table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").alias("run_id"), pick("metrics", "logs", "traces").alias("signal"), line.alias("line")))


@query(f"""WITH {_CAPTURE_SQL} SELECT run_id, signal, count(*) AS batches, count(*) FILTER (broken) AS broken, coalesce(array_to_string(list_sort(list(DISTINCT s) FILTER (s IS NOT NULL)), ','), '') AS services FROM c GROUP BY run_id, signal""")
def capture_counts(spark, d):
    """Lines of a run's signals, by day: batches, broken ones, services."""
    return _capture(spark, d).withColumn("services", F.array_join("services", ","))


@query(f"""WITH {_CAPTURE_SQL}, u AS (SELECT run_id, count(DISTINCT signal) FILTER (NOT broken) AS signals, count(*) FILTER (broken) AS broken, list(DISTINCT s) FILTER (s IS NOT NULL) AS seen FROM c GROUP BY run_id), x AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS run_id FROM events)
SELECT run_id, CASE WHEN coalesce(signals, 0) < 3 THEN 'signal_missing' WHEN broken > 0 THEN 'broken_lines' WHEN seen IS NULL THEN 'no_service' WHEN NOT list_has_all(seen, ['svc-1', CASE WHEN run_id LIKE '%1' THEN 'svc-x' ELSE 'svc-2' END]) THEN 'expected_service_unseen' END AS error FROM x LEFT JOIN u USING (run_id)""")
def capture_checks(spark, d):
    """The first rule that a day's capture breaks; expected services by rule."""
    runs = table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").alias("run_id")).distinct()
    expected = runs.withColumn("services", F.array(F.lit("svc-1"), F.when(F.col("run_id").endswith("1"), "svc-x").otherwise("svc-2")))
    return campaigns.capture_errors(_capture(spark, d), expected)


@query("""WITH w AS (SELECT o_custkey AS run_id, CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 97 = 0 THEN 'normal' WHEN o_custkey % 3 = 0 THEN 'cart' ELSE 'payment' END AS scenario, o_orderpriority AS service FROM orders), r AS (SELECT run_id, min(scenario) AS s, count(DISTINCT scenario) > 1 AS torn FROM w GROUP BY run_id),
a AS (SELECT count(*) AS runs, count(*) FILTER (torn) AS conflicts, array_to_string(list_filter([CASE WHEN count(*) FILTER (s = 'normal') < 20 THEN 'normal' END, CASE WHEN count(*) FILTER (s = 'cart') < 5 THEN 'cart' END, CASE WHEN count(*) FILTER (s = 'disk') < 1 THEN 'disk' END], lambda x: x IS NOT NULL), ',') AS short FROM r),
b AS (SELECT count(*) FILTER (scenario = 'normal' AND service <> '5-LOW') AS normal_windows, count(DISTINCT service) FILTER (service = '5-LOW') AS excluded_services FROM w), c AS (SELECT count(DISTINCT CASE WHEN c_custkey % 50 = 3 THEN 61 ELSE 60 END) AS durations FROM customer SEMI JOIN r ON run_id = c_custkey)
SELECT *, false AS ready FROM a, b, c""")
def readiness(spark, d):
    """Customers as runs, their orders as windows."""
    k = F.col("o_custkey")
    scenario = F.when((k % 2 == 0) | (F.col("o_orderkey") % 97 == 0), "normal").when(k % 3 == 0, "cart").otherwise("payment")
    w = table(spark, d, "orders").select(k.alias("run_id"), scenario.alias("scenario"), F.col("o_orderpriority").alias("service_name"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 50 == 3, 61).otherwise(60).alias("duration_seconds"))
    return campaigns.readiness(w, t, {"normal": 20, "cart": 5, "disk": 1}, 100, ["5-LOW"])


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_suppkey, ['RUNNING','NO_ANOMALY_SIGNAL','GROUNDED_ADVISORY','INSUFFICIENT_EVIDENCE','FAILED'][(l_suppkey % 5 + 1)::INT] AS s, 'code-' || (l_suppkey % 3) AS code FROM lineitem)
SELECT l_orderkey, arg_max(s, (l_linenumber, l_suppkey)) AS status, max(l_linenumber) FILTER (s <> 'RUNNING') AS completed_at, (arg_max(struct_pack(c := CASE WHEN s = 'FAILED' THEN code END), (l_linenumber, l_suppkey)) FILTER (s <> 'RUNNING')).c AS failure_code, count(*) AS entries FROM e GROUP BY l_orderkey""")
def analysis_runs(spark, d):
    """Lines as events of an order's analysis run."""
    names = F.array(F.lit("RUNNING"), *map(F.lit, campaigns.FINAL))
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("state"), F.concat(F.lit("code-"), (F.col("l_suppkey") % 3).cast("string")).alias("code"))
    return campaigns.run_states(e, "l_orderkey", ["l_linenumber", "l_suppkey"], "state", "code")


_SETTINGS = {"version": 1, "by": "lang"}


@query(f"""WITH h AS (SELECT lang, sha256(doc_id || '|' || coalesce(lang, chr(0)) || '|' || coalesce(text, chr(0))) AS h FROM documents), g AS (SELECT lang, count(*) AS rows, {", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT)::VARCHAR AS w{i}" for i in range(4))} FROM h GROUP BY lang)
SELECT lang, rows, digest, 'corpus-v1-' || substr(sha256('{{"by":"lang","content":"' || digest || '","version":1}}'), 1, 12) AS dataset_id FROM (SELECT lang, rows, sha256(concat_ws('|', rows, w0, w1, w2, w3)) AS digest FROM g)""")
def corpus_fingerprint(spark, d):
    """Identities of the documents of each language, whatever their order."""
    f = campaigns.digest(table(spark, d, "documents").select("doc_id", "lang", "text"), ["lang"])
    return f.withColumn("dataset_id", campaigns.dataset_id("corpus-v1", _SETTINGS, F.col("digest")))


@query("""WITH h AS (SELECT sha256(event_id || '|' || event_type || '|' || user_id) AS h FROM events), g AS (SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 8))::UBIGINT)::VARCHAR AS a, sum(('0x' || substr(h, 9, 8))::UBIGINT)::VARCHAR AS b, sum(('0x' || substr(h, 17, 8))::UBIGINT)::VARCHAR AS c, sum(('0x' || substr(h, 25, 8))::UBIGINT)::VARCHAR AS d FROM h)
SELECT 'events-v1-' || substr(sha256('{"by":"lang","content":"' || sha256(concat_ws('|', rows, a, b, c, d)) || '","version":1}'), 1, 12) AS dataset_id, rows, true AS whole FROM g""")
def dataset_round_trip(spark, d):
    """Events written as a dataset with its manifest, read again and checked."""
    rows, at = table(spark, d, "events").select("event_id", "event_type", "user_id"), folder(spark, "dataset")
    campaigns.write_dataset(rows, at, "events-v1", _SETTINGS)
    return campaigns.verify_dataset(spark, at, rows.schema, "events-v1", _SETTINGS)
