"""Further registered queries: inventories, imputation, splits, summaries, integrity, incident folds, estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import terms, window_start
from vigil.operators import anomaly, corpus, models, windows
from vigil.plans.catalog import BASE_SQL, QUERIES, SCORED, SQL, STATES, TERMS_SQL, query, scored
from vigil.sources.tables import OBS_SQL, observations, table

__all__ = ["QUERIES", "SQL"]


@query(f"""WITH {OBS_SQL} SELECT event_id, ts_us // 60000000 * 60000000 AS start_us, ts_us // 60000000 * 60000000 + 60000000 AS end_us, ts_us % 60000000 AS into_us FROM obs""")
def win_boundaries(spark, d):
    start = window_start(F.col("ts_us"), 60)
    return observations(spark, d).select("event_id", start.alias("start_us"), (start + 60_000_000).alias("end_us"), (F.col("ts_us") - start).alias("into_us"))


@query("""SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT source) > 1 OR count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY 1""")
def dedup_conflicts(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))
    return g.withColumn("conflict", (F.col("sources") > 1) | (F.col("langs") > 1))


@query(f"""WITH {OBS_SQL} SELECT metric_name, count(*) AS n, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services, count(DISTINCT run_id) AS runs FROM obs GROUP BY metric_name""")
def inventory(spark, d):
    return observations(spark, d).groupBy("metric_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("service_name")), ",").alias("services"), F.count_distinct("run_id").alias("runs"))


@query(f"""WITH {OBS_SQL}, {BASE_SQL.format(name='b', by='metric_name')} SELECT metric_name, n, round(center, 6) AS center, round(scale, 6) AS scale, informative FROM b""")
def baseline_global(spark, d):
    b = anomaly.robust_baseline(observations(spark, d), ["metric_name"], "numeric_value")
    return b.select("metric_name", "n", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "informative")


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DOUBLE END AS v FROM orders), m AS (SELECT median(v) AS m FROM g) SELECT o_orderkey, round(coalesce(v, m), 6) AS v FROM g, m""")
def impute_median(spark, d):
    """Prices with gaps made by rule, filled with the median of the others."""
    g = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("double")).alias("v"))
    return models.impute(g, ["v"]).select("o_orderkey", F.round("v", 6).alias("v"))


@query(f"""WITH {SCORED} SELECT run_id, count(*) AS n, max(score) AS score, max(truth) AS truth, max(score) > 45 AS predicted FROM scored GROUP BY run_id""")
def run_level_max(spark, d):
    return scored(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.max("truth").alias("truth")).withColumn("predicted", F.col("score") > 45)


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, c_custkey % 3 = 0 AS fresh FROM customer), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY c_mktsegment) AS k FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (NOT fresh AND k >= 2), sha256('42:' || c_mktsegment || ':' || c_custkey)) AS place FROM n)
SELECT c_custkey, c_mktsegment, fresh, place::INT AS place, CASE WHEN place <= 2 THEN 'test' ELSE 'development' END AS split FROM p""")
def holdout_hash(spark, d):
    return anomaly.holdout(table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 3 == 0).alias("fresh")), "c_mktsegment", "c_custkey", "fresh", "42").withColumn("place", F.col("place").cast("int"))


@query(f"""SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND list_has_any({TERMS_SQL}, ['license', 'error', 'the'])""")
def filter_overlap(spark, d):
    """Any of several terms, and one of several languages."""
    return table(spark, d, "documents").where(F.col("lang").isin("en", "de") & F.arrays_overlap(terms(F.col("text")), F.array(*map(F.lit, ("license", "error", "the"))))).select("doc_id", "lang")


@query("""SELECT d.source, count(*) AS documents, count(*) FILTER (l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source
UNION ALL SELECT 'orphan labels', count(*), 0 FROM labels ANTI JOIN documents USING (doc_id)""")
def missing_docs(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.lit(1).alias("known"))
    a = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("known").isNull()).alias("unlabelled"))
    orphans = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("documents"))
    return a.unionByName(orphans.select(F.lit("orphan labels").alias("source"), "documents", F.lit(0).cast("long").alias("unlabelled")))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer""")
def scalar_subquery_count(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN ['unknown_role'] ELSE [] END || CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN ['empty_text'] ELSE [] END || CASE WHEN turn < 0 THEN ['negative_turn'] ELSE [] END
|| CASE WHEN length(text) > 400 THEN ['too_long'] ELSE [] END AS r FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(r)), ',') AS reasons, len(r) = 0 AS valid FROM c""")
def citations_structural(spark, d):
    """Turns as answers, with the sorted reasons for which they are structurally invalid."""
    rules = {"unknown_role": ~F.col("role").isin("user", "assistant"), "empty_text": F.col("text").isNull() | (F.trim("text") == ""), "negative_turn": F.col("turn") < 0, "too_long": F.length("text") > 400}
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("valid"))


@query("""WITH c AS (SELECT source, unnest(CASE WHEN n_chars < 200 THEN ['short'] ELSE [] END || CASE WHEN n_chars > 3000 THEN ['long'] ELSE [] END || CASE WHEN lang <> 'en' THEN ['foreign'] ELSE [] END) AS category FROM documents)
SELECT source, category, count(*) AS n FROM c GROUP BY ALL""")
def failure_counts(spark, d):
    rules = {"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 3000, "foreign": F.col("lang") != "en"}
    c = table(spark, d, "documents").select("source", F.explode(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))).alias("category"))
    return c.groupBy("source", "category").agg(F.count("*").alias("n"))


@query("""WITH u AS (UNPIVOT (SELECT l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS discount FROM lineitem) ON quantity, price, discount INTO NAME metric VALUE v)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM u GROUP BY metric""")
def latency_summary(spark, d):
    named = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    wide = table(spark, d, "lineitem").select(*(F.col(c).cast("double").alias(k) for k, c in named.items()))
    return windows.distribution(wide.unpivot([], list(named), "metric", "v"), ["metric"], "v")


RATED_SQL = "r AS (SELECT o_orderkey, o_orderpriority AS t, CASE WHEN o_totalprice > 150000 THEN '1-URGENT' ELSE '5-LOW' END AS p FROM orders)"


def _rated(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("t"), F.when(F.col("o_totalprice") > 150000, "1-URGENT").otherwise("5-LOW").alias("p"))


@query(f"""WITH {RATED_SQL}, k AS (SELECT coalesce(a.t, b.p) AS class, coalesce(support, 0) AS support, coalesce(hit / nullif(chosen, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re
 FROM (SELECT t, count(*) AS support, count(*) FILTER (t = p) AS hit FROM r GROUP BY t) a FULL JOIN (SELECT p, count(*) AS chosen FROM r GROUP BY p) b ON a.t = b.p),
s AS (SELECT round(avg(re) FILTER (support > 0), 5) AS balanced_accuracy, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 5) AS macro_f1, round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * support) / sum(support), 5) AS weighted_f1 FROM k)
SELECT n, accuracy, log_loss, balanced_accuracy, macro_f1, weighted_f1 FROM (SELECT count(*) AS n, round(avg((t = p)::INT), 6) AS accuracy, round(avg(-ln(CASE WHEN t = p THEN 0.7 ELSE 0.075 END)), 6) AS log_loss FROM r), s""")
def multiclass_summary(spark, d):
    r = _rated(spark, d).withColumn("q", F.when(F.col("t") == F.col("p"), 0.7).otherwise(0.075))
    return anomaly.multiclass_summary(r, "t", "p", "q")


@query(f"""WITH {RATED_SQL}, f AS (SELECT o_orderkey % 5 AS fold, avg((t = p)::INT) AS accuracy FROM r GROUP BY 1) SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM f""")
def cross_validation_summary(spark, d):
    f = _rated(spark, d).groupBy(F.col("o_orderkey") % 5).agg(F.avg((F.col("t") == F.col("p")).cast("int")).alias("accuracy"))
    return f.agg(F.count("*").alias("folds"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("std"))


@query("""WITH e AS (SELECT l_orderkey, list(['OPEN','INVESTIGATING','MITIGATED','RESOLVED','CLOSED'][(l_suppkey % 5 + 1)::INT] ORDER BY l_linenumber, l_suppkey) AS s FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, len(s) AS events, string_split(list_reduce(['OPEN#'] || s, lambda a, x: CASE WHEN string_split(a, '#')[1] || '>' || x IN ('OPEN>INVESTIGATING','OPEN>RESOLVED','INVESTIGATING>MITIGATED','INVESTIGATING>RESOLVED','MITIGATED>INVESTIGATING','MITIGATED>RESOLVED','RESOLVED>INVESTIGATING','RESOLVED>CLOSED')
 THEN x || '#' || string_split(a, '#')[2] || '+' ELSE a END), '#') AS z FROM e) SELECT l_orderkey, events::BIGINT AS events, z[1] AS state, length(z[2])::BIGINT AS applied FROM f""")
def incident_fold(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.element_at(F.array(*map(F.lit, STATES)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("state"))
    return corpus.fold_states(e, "l_orderkey", ["l_linenumber", "l_suppkey"], "state")


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in LINE), (F.col("l_returnflag") == "R").cast("double").alias("label"), (F.pmod(F.xxhash64("l_orderkey"), F.lit(4)) == 0).alias("held_out"))


@query()
def isolation_forest(spark, d):
    """Rows only: trees come from numpy's generator."""
    return models.isolation_forest(_lines(spark, d), ["l_orderkey", "l_linenumber"], LINE)


@query()
def mllib_logreg(spark, d):
    """Rows only: MLlib's optimizer."""
    return models.classify(_lines(spark, d), ["l_orderkey", "l_linenumber"], LINE, "label", "logistic")


@query()
def mllib_forest(spark, d):
    """Rows only: MLlib's trees."""
    return models.classify(_lines(spark, d), ["l_orderkey", "l_linenumber"], LINE, "label", "forest")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, total FROM (SELECT *, count(*) OVER () AS total FROM lineitem WHERE l_returnflag = 'R') ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 100""")
def timeline_page(spark, d):
    """The third page of 50 events, oldest first, with the number of all."""
    t = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    rows = corpus.page(t, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 2, 50)
    return rows.join(t.agg(F.count("*").alias("total"))).select("l_orderkey", "l_linenumber", "l_shipdate", "total")  # one row beside a page


@query("""SELECT source, lang, quality, count(*) AS cases, count(*) FILTER (doc_id % 5 = 0) AS final, count(*) FILTER (doc_id % 5 = 0) > 0 AND count(*) FILTER (doc_id % 5 <> 0) > 0 AS balanced
FROM documents JOIN labels USING (doc_id) GROUP BY source, lang, quality""")
def benchmark_balance(spark, d):
    """Cases by family, style and class, those of the final split, and whether both splits have some."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    final = F.count_if(F.col("doc_id") % 5 == 0)
    return t.groupBy("source", "lang", "quality").agg(F.count("*").alias("cases"), final.alias("final"), ((final > 0) & (final < F.count("*"))).alias("balanced"))


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS q FROM benchmark), e AS (SELECT item_id, q FROM b WHERE item_id % 2 = 0)
SELECT b.item_id, count(e.item_id) > 0 AS reused FROM b LEFT JOIN e ON e.q = b.q AND e.item_id < b.item_id GROUP BY b.item_id""")
def query_reuse(spark, d):
    """Whether an earlier benchmark, here the items of even number, has a text already, case and white space aside."""
    q = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))
    b = table(spark, d, "benchmark").select("item_id", q.alias("q"))
    first = b.where(F.col("item_id") % 2 == 0).groupBy("q").agg(F.min("item_id").alias("first"))
    return b.join(first, "q", "left").select("item_id", F.coalesce(F.col("first") < F.col("item_id"), F.lit(False)).alias("reused"))


@query("""WITH s AS (SELECT doc_id, 'train' AS split FROM labels WHERE doc_id % 10 < 6 UNION ALL SELECT doc_id, 'validation' FROM labels WHERE doc_id % 10 BETWEEN 6 AND 7 UNION ALL SELECT doc_id, 'test' FROM labels WHERE doc_id % 10 >= 7),
u AS (SELECT doc_id, count(DISTINCT split) AS splits FROM s GROUP BY doc_id) SELECT count(*) FILTER (splits > 1) AS shared, count(*) FILTER (known AND splits IS NULL) AS uncovered, count(*) FILTER (known IS NULL) AS unknown, count(*) FILTER (splits > 1) = 0 AND count(*) FILTER (splits IS NULL OR known IS NULL) = 0 AS exact
FROM (SELECT DISTINCT doc_id, true AS known FROM labels WHERE doc_id IS NOT NULL) k FULL JOIN u ON u.doc_id = k.doc_id""")
def split_cover(spark, d):
    """Whether splits are disjoint and cover every id; here two share the ids that end in 7."""
    m = F.col("doc_id") % 10
    names = F.array_compact(F.array(F.when(m < 6, "train"), F.when(m.between(6, 7), "validation"), F.when(m >= 7, "test")))
    labels = table(spark, d, "labels").select("doc_id")
    return anomaly.split_cover(labels.select("doc_id", F.explode(names).alias("split")), labels, "doc_id", "split")
