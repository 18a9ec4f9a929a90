"""Queries over incidents, raw records, model choice and folds, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import anomaly, incidents
from vigil.plans.catalog import STATES, query, scored, SCORED
from vigil.sources.tables import table

_LEGAL = "('OPEN>INVESTIGATING','OPEN>RESOLVED','INVESTIGATING>MITIGATED','INVESTIGATING>RESOLVED','MITIGATED>INVESTIGATING','MITIGATED>RESOLVED','RESOLVED>INVESTIGATING','RESOLVED>CLOSED')"


@query(f"""WITH RECURSIVE e AS (SELECT l_orderkey, l_linenumber, ['OPEN','INVESTIGATING','MITIGATED','RESOLVED','CLOSED'][(l_suppkey % 5 + 1)::INT] AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i FROM lineitem),
f AS (SELECT l_orderkey, 0::BIGINT AS i, 'OPEN' AS s, NULL::BIGINT AS r, NULL::BIGINT AS c, 0::BIGINT AS n FROM (SELECT DISTINCT l_orderkey FROM e) UNION ALL
 SELECT f.l_orderkey, e.i, CASE WHEN f.s || '>' || e.s IN {_LEGAL} THEN e.s ELSE f.s END, CASE WHEN f.s || '>' || e.s NOT IN {_LEGAL} THEN f.r WHEN e.s = 'RESOLVED' THEN e.l_linenumber WHEN f.s = 'RESOLVED' AND e.s = 'INVESTIGATING' THEN NULL ELSE f.r END,
 CASE WHEN f.s || '>' || e.s IN {_LEGAL} AND e.s = 'CLOSED' THEN e.l_linenumber ELSE f.c END, f.n + (f.s || '>' || e.s IN {_LEGAL})::INT FROM f JOIN e ON e.l_orderkey = f.l_orderkey AND e.i = f.i + 1)
SELECT l_orderkey, max_by(s, i) AS state, (max_by(struct_pack(r := r), i)).r AS resolved_at, (max_by(struct_pack(c := c), i)).c AS closed_at, max_by(n, i) AS applied FROM f GROUP BY l_orderkey""")
def incident_effects(spark, d):
    """Incidents after all events, with the dates of their resolution and closing; a line's number stands for its time."""
    e = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", F.element_at(F.array(*map(F.lit, STATES)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("state"))
    return incidents.fold_effects(e, "l_orderkey", ["l_linenumber", "l_suppkey"], "state", "l_linenumber")


@query("""WITH u AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS owner, CASE WHEN event_id % 2 = 0 THEN props END AS note FROM events)
SELECT user_id, nullif(arg_max(trim(owner), event_id) FILTER (owner IS NOT NULL), '') AS owner, nullif(arg_max(trim(note), event_id) FILTER (note IS NOT NULL), '') AS note, count(*) FILTER (owner IS NOT NULL OR note IS NOT NULL) AS changes FROM u GROUP BY user_id""")
def partial_updates(spark, d):
    """Updates in which missing fields keep and blank ones clear; made of events by rule."""
    i = F.col("event_id")
    u = table(spark, d, "events").select("user_id", "event_id", F.when(i % 3 == 0, None).when(i % 7 == 0, "  ").otherwise(F.col("event_type")).alias("owner"), F.when(i % 2 == 0, F.col("props")).alias("note"))
    return incidents.latest_fields(u, "user_id", ["event_id"], ["owner", "note"])


@query("""SELECT l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT lower(l_returnflag || l_linestatus)) FILTER (l_linenumber <> 2)), ','), '') AS services FROM lineitem GROUP BY l_orderkey""")
def affected_services(spark, d):
    """Names by incident, normalised; every second line's name is blank."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 2, " ").otherwise(F.concat(F.lit(" "), F.upper(F.concat("l_returnflag", "l_linestatus")))).alias("name"))
    return incidents.services_of(rows, "l_orderkey", "name")


_RECORDS_SQL = """r AS (SELECT event_id AS o, props, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'telemetry.raw' END AS t, ['metrics','logs','traces','profiles'][(event_id % 4 + 1)::INT] AS s, 'svc-' || (user_id % 10) AS svc,
 ['resourceMetrics','resourceLogs','resourceSpans','x'][(event_id % 4 + 1)::INT] AS root FROM events), v AS (SELECT *, CASE o % 6 WHEN 0 THEN '{"' || root || '":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"' || svc || '"}}]}}]}' WHEN 1 THEN '{' WHEN 2 THEN '[1]' WHEN 3 THEN '{"' || root || '":{}}' ELSE props END AS v FROM r)"""


@query(f"""WITH {_RECORDS_SQL}, e AS (SELECT *, CASE WHEN t = '' THEN 'missing_header' WHEN s = 'profiles' THEN 'unsupported_signal' WHEN o % 6 = 1 THEN 'invalid_json' WHEN o % 6 IN (2, 3) THEN 'invalid_structure' END AS error, sha256('raw:' || (o % 4) || ':' || o) AS event_id FROM v)
SELECT event_id, s AS signal, error, CASE WHEN error IS NULL THEN CASE WHEN o % 6 = 0 THEN svc ELSE '' END END AS services, CASE WHEN error IS NULL AND o % 6 = 0 THEN svc ELSE event_id END AS key, CASE WHEN error IS NOT NULL THEN base64(v::BLOB) END AS payload_base64 FROM e""")
def processed_events(spark, d):
    """Raw records, some broken by rule, as processed events or dead letters."""
    i = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % 4 + 1).cast("int"))
    root, service = pick(("resourceMetrics", "resourceLogs", "resourceSpans", "x")), F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string"))
    whole = F.concat(F.lit('{"'), root, F.lit('":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'), service, F.lit('"}}]}}]}'))
    v = F.when(i % 6 == 0, whole).when(i % 6 == 1, "{").when(i % 6 == 2, "[1]").when(i % 6 == 3, F.concat(F.lit('{"'), root, F.lit('":{}}'))).otherwise(F.col("props"))
    headers = F.create_map(F.lit("event_type"), F.when(i % 17 == 0, "").otherwise("telemetry.raw"), F.lit("schema_version"), F.lit("1"), F.lit("signal"), pick(("metrics", "logs", "traces", "profiles")))
    raw = table(spark, d, "events").select(F.lit("raw").alias("topic"), (i % 4).alias("partition"), i.alias("offset"), headers.alias("headers"), v.cast("binary").alias("value"))
    p = incidents.processed(raw)
    return p.select("event_id", "signal", "error", F.array_join("services", ",").alias("services"), "key", "payload_base64")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, [struct_pack(d := -abs(l_quantity::DOUBLE - 25) / 12, n := 'quantity'), struct_pack(d := -abs(l_extendedprice::DOUBLE - 35000) / 20000, n := 'price'), struct_pack(d := -abs(l_discount::DOUBLE - 0.05::DOUBLE) / 0.03::DOUBLE, n := 'discount'), struct_pack(d := -abs(l_tax::DOUBLE - 0.04::DOUBLE) / 0.02::DOUBLE, n := 'tax')] AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort(a)[1:2], lambda x: x.n), ',') AS contributors FROM d""")
def top_contributors(spark, d):
    """The two columns of a line that deviate most."""
    t = table(spark, d, "lineitem")
    dev = lambda c, m, s: F.abs(F.col(c).cast("double") - m) / s
    found = incidents.contributors(t, {"quantity": dev("l_quantity", 25, 12), "price": dev("l_extendedprice", 35000, 20000), "discount": dev("l_discount", 0.05, 0.03), "tax": dev("l_tax", 0.04, 0.02)}, 2)
    return found.select("l_orderkey", "l_linenumber", "contributors")


@query("""WITH p AS (SELECT event_id, event_id % 7 + 1 AS a, event_id % 5 + 1 AS b, event_id % 3 + 1 AS c FROM events), q AS (SELECT event_id, list_sort([struct_pack(p := -a / (a + b + c), n := 'a'), struct_pack(p := -b / (a + b + c), n := 'b'), struct_pack(p := -c / (a + b + c), n := 'c')]) AS l FROM p)
SELECT l[1].n AS first, l[2].n AS second, true AS whole, count(*) AS n FROM q GROUP BY ALL""")
def class_probabilities(spark, d):
    """First and second class of probabilities made by rule."""
    e = table(spark, d, "events").select(*((F.col("event_id") % m + 1).alias(n) for n, m in (("a", 7), ("b", 5), ("c", 3))))
    total = F.col("a") + F.col("b") + F.col("c")
    return incidents.top_classes(e, {n: F.col(n) / total for n in "abc"}).groupBy("first", "second", "whole").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORED}, c AS (SELECT service_name, count(*) FILTER (score > 40 AND truth = 1) / greatest(count(*) FILTER (truth = 1), 1) AS recall, count(*) FILTER (score > 40 AND truth = 0) / greatest(count(*) FILTER (truth = 0), 1) AS fpr FROM scored GROUP BY service_name)
SELECT (SELECT service_name FROM c ORDER BY fpr > 0.3, -recall, fpr, service_name LIMIT 1) AS chosen, (SELECT count(*) FROM c) AS candidates""")
def model_choice(spark, d):
    """Candidates by whether they keep a false positive rate, then recall, then that rate, then name."""
    m = anomaly.binary_metrics(scored(spark, d), "truth", "score", 40, ["service_name"])
    pos, neg = F.greatest(F.col("true_positive") + F.col("false_negative"), F.lit(1)), F.greatest(F.col("false_positive") + F.col("true_negative"), F.lit(1))
    recall, fpr = F.col("true_positive") / pos, F.col("false_positive") / neg
    return incidents.select_best(m, "service_name", [(fpr > 0.3).alias("a"), (-recall).alias("b"), fpr.alias("c")])


@query("""SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_mktsegment || ':' || c_custkey)) - 1) % 5)::INT AS fold FROM customer""")
def stratified_folds(spark, d):
    return incidents.stratified_folds(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5, "42")


@query("""WITH a AS (SELECT l_orderkey, avg(l_quantity::DOUBLE) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey, avg(l_quantity::DOUBLE) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT count(*) AS cases, round(avg(a.v), 6) AS mean_a, round(avg(b.v), 6) AS mean_b, round(avg(a.v - b.v), 6) AS difference, count(*) FILTER (a.v > b.v) AS better, count(*) FILTER (a.v = b.v) AS equal, count(*) FILTER (a.v < b.v) AS worse FROM a JOIN b USING (l_orderkey)""")
def paired_comparison(spark, d):
    """Two variants of a case's value, compared case by case."""
    t = table(spark, d, "lineitem").withColumn("v", F.col("l_quantity").cast("double"))
    one = lambda c: t.where(c).groupBy("l_orderkey").agg(F.avg("v").alias("v"))
    return incidents.paired(one("l_linenumber <= 3"), one("l_linenumber >= 2"), "l_orderkey", "v")


@query("""SELECT l_returnflag, n, floor(center * 1e4 + 0.5) / 1e4 AS center, floor(CASE WHEN mad > 0 THEN mad WHEN iqr > 0 THEN iqr ELSE 1 END * 1e4 + 0.5) / 1e4 AS scale FROM (SELECT l_returnflag, count(*) AS n, any_value(q[2]) AS center, 1.4826 * median(abs(v - q[2])) AS mad, any_value(q[3] - q[1]) / 1.349 AS iqr
 FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS v, quantile_cont(l_extendedprice::DOUBLE, [0.25, 0.5, 0.75]) OVER (PARTITION BY l_returnflag) AS q FROM lineitem) GROUP BY l_returnflag)""")
def column_scales(spark, d):
    """Median and robust scale of a column by group."""
    b = anomaly.robust_baseline(table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v")), ["l_returnflag"], "v")
    fixed = lambda c: (F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c)
    return b.select("l_returnflag", "n", fixed("center"), fixed("scale"))
