"""Registered queries over the star tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.columns import fixed, mean_of_largest, normal_text, severity_group, terms
from vigil.operators import anomaly, answers, corpus, retrieval, windows
from vigil.sources import otlp
from vigil.sources.tables import OBS_SQL, folder, observations, table
from vigil.streaming import route

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: A score and a truth for every observation: how far its value is from 50, and whether it is an error; errors of some services are the faults.
SCORED = f"""{OBS_SQL}, scored AS (SELECT *, floor(abs(numeric_value - 50) * 10 + 0.5) / 10 AS score, (metric_name = 'error')::INT AS truth FROM obs)"""
TERMS_SQL = r"""flatten([[w] || CASE WHEN regexp_matches(w, '[._-]') THEN string_split_regex(w, '[._-]') ELSE [] END FOR w IN regexp_extract_all(lower(text), '[a-z0-9]+(?:[._-][a-z0-9]+)*')])"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).withColumn("score", fixed(F.abs(F.col("numeric_value") - 50), 1)).withColumn("truth", (F.col("metric_name") == "error").cast("int"))


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, ts_us // 3600000000 * 3600000000 AS start_us FROM obs)
SELECT sha256(run_id || '|' || service_name || '|' || start_us || '|3600|' || metric_name) AS window_id, run_id, service_name, start_us, start_us + 3600000000 AS end_us, metric_name,
 count(*) AS point_count, count(DISTINCT series) AS series_count, round(avg(numeric_value), 6) AS mean, round(stddev_pop(numeric_value), 6) AS std, min(numeric_value) AS min, max(numeric_value) AS max,
 round(quantile_cont(numeric_value, 0.5), 6) AS p50, round(quantile_cont(numeric_value, 0.95), 6) AS p95, round(quantile_cont(numeric_value, 0.99), 6) AS p99,
 arg_min(numeric_value, (ts_us, series, event_id)) AS first, arg_max(numeric_value, (ts_us, series, event_id)) AS last
FROM w GROUP BY run_id, service_name, start_us, metric_name""")
def win_metric_long(spark, d):
    return windows.metric_windows(observations(spark, d), 3600)


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, ts_us // 3600000000 * 3600000000 AS start_us FROM obs)
SELECT run_id, service_name, start_us, count(*) AS observation_count, count(DISTINCT event_id) AS source_event_count, count(DISTINCT metric_name) AS metric_name_count,
 count(*) FILTER (metric_name = 'error') AS error_count, max(numeric_value) FILTER (metric_name = 'error') AS error_value_max,
 round(count(*) FILTER (metric_name = 'error') / count(*), 6) AS error_rate, sha256(run_id || '|' || service_name || '|' || start_us || '|3600') AS window_id
FROM w GROUP BY run_id, service_name, start_us""")
def win_service_wide(spark, d):
    return windows.service_windows(observations(spark, d), "error", 3600)


@query(f"""WITH {OBS_SQL}, two AS (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE metric_name = 'error')
SELECT event_id, arg_min(run_id, ts_us) AS run_id, arg_min(numeric_value, ts_us) AS numeric_value, count(DISTINCT numeric_value) > 1 AS conflict FROM two GROUP BY event_id""")
def dedup_first(spark, d):
    o = observations(spark, d)
    two = o.unionByName(o.where("metric_name = 'error'"))
    return windows.first_of_each(two, "event_id", ["ts_us"], ["run_id", "numeric_value"]).select("event_id", "run_id", "numeric_value", "conflict")


@query(f"""WITH {OBS_SQL} SELECT service_name, count(*) AS n, count(*) FILTER (ts_us IS NULL) AS missing_time, count(*) FILTER (numeric_value IS NULL) AS missing_value,
 count(*) FILTER (isnan(numeric_value) OR isinf(numeric_value)) AS non_finite, count(*) FILTER (numeric_value < 0) AS negative, 0.0::DOUBLE + count(*) FILTER (ts_us IS NULL) / count(*) AS missing_time_rate FROM obs GROUP BY service_name""")
def quality_counters(spark, d):
    return windows.quality_counters(observations(spark, d))


@query("""SELECT CASE WHEN event_id % 27 BETWEEN 1 AND 24 THEN ['TRACE','DEBUG','INFO','WARN','ERROR','FATAL'][((event_id % 27 - 1) // 4 + 1)::INT] ELSE 'UNSPECIFIED' END AS severity, count(*) AS n FROM events GROUP BY 1""")
def severity_case(spark, d):
    return table(spark, d, "events").groupBy(severity_group(F.col("event_id") % 27).alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type""")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


BASE_SQL = """{name} AS (SELECT {by}, count(v) AS n, any_value(q[2]) AS center, CASE WHEN 1.4826 * median(abs(v - q[2])) > 0 THEN 1.4826 * median(abs(v - q[2])) WHEN any_value(q[3] - q[1]) > 0 THEN any_value(q[3] - q[1]) / 1.349 ELSE 1.0 END AS scale,
 median(abs(v - q[2])) > 0 OR any_value(q[3] - q[1]) > 0 AS informative FROM (SELECT {by}, numeric_value AS v, quantile_cont(numeric_value, [0.25, 0.5, 0.75]) OVER (PARTITION BY {by}) AS q FROM obs) GROUP BY {by})"""


@query(f"""WITH {OBS_SQL}, {BASE_SQL.format(name='b', by='service_name, metric_name')} SELECT service_name, metric_name, n, round(center, 6) AS center, round(scale, 6) AS scale, informative FROM b""")
def baseline_service(spark, d):
    b = anomaly.robust_baseline(observations(spark, d), ["service_name", "metric_name"], "numeric_value")
    return b.select("service_name", "metric_name", "n", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "informative")


@query(f"""WITH {OBS_SQL}, {BASE_SQL.format(name='f', by='run_id, metric_name')}, {BASE_SQL.format(name='g', by='metric_name')},
 x AS (SELECT o.run_id, CASE WHEN coalesce(f.informative, g.informative) THEN abs(numeric_value - coalesce(f.center, g.center)) / coalesce(f.scale, g.scale) WHEN g.center IS NOT NULL THEN 0.0 END AS dv
 FROM obs o LEFT JOIN f ON f.run_id = o.run_id AND f.metric_name = o.metric_name AND f.n >= 5 LEFT JOIN g ON g.metric_name = o.metric_name)
SELECT run_id, count(dv) AS matched, round(avg(dv), 6) AS mean, round(max(dv), 6) AS max, count(*) FILTER (dv > 3) AS over3, count(*) FILTER (dv > 5) AS over5, round(quantile_cont(dv, 0.95), 6) AS p95 FROM x GROUP BY run_id""")
def deviation_window(spark, d):
    o = observations(spark, d)
    fine, wide = anomaly.robust_baseline(o, ["run_id", "metric_name"], "numeric_value"), anomaly.robust_baseline(o, ["metric_name"], "numeric_value")
    x = anomaly.deviations(o, fine, wide, ["run_id", "metric_name"], ["metric_name"], "numeric_value")
    v = F.col("deviation")
    return x.groupBy("run_id").agg(F.count(v).alias("matched"), F.round(F.avg(v), 6).alias("mean"), F.round(F.max(v), 6).alias("max"), F.count_if(v > 3).alias("over3"), F.count_if(v > 5).alias("over5"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"))


@query("""SELECT l_orderkey, l_linenumber, floor((a[1] + a[2]) / 2 * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS score FROM (SELECT l_orderkey, l_linenumber, list_sort([abs(l_quantity::DOUBLE - 25) / 12, abs(l_extendedprice::DOUBLE - 35000) / 20000, abs(l_discount::DOUBLE - 0.05::DOUBLE) / 0.03::DOUBLE, abs(l_tax::DOUBLE - 0.04::DOUBLE) / 0.02::DOUBLE], 'DESC') AS a FROM lineitem)""")
def robust_score_topk(spark, d):
    dev = lambda c, m, s: F.abs(F.col(c).cast("double") - m) / s
    a = F.array(dev("l_quantity", 25, 12), dev("l_extendedprice", 35000, 20000), dev("l_discount", 0.05, 0.03), dev("l_tax", 0.04, 0.02))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fixed(mean_of_largest(a, 2)).alias("score"))


@query(f"""WITH {SCORED}, t AS (SELECT list_sort(list(score))[ceil((count(*) - 1) * (1 - 0.05))::INT + 1] AS threshold, count(*) AS n FROM scored)
SELECT threshold, n, count(*) FILTER (score > threshold) AS above, count(*) FILTER (score > threshold) / n AS fpr FROM scored, t GROUP BY threshold, n""")
def threshold_higher(spark, d):
    return anomaly.threshold(scored(spark, d), "score", 0.05)


@query(f"""WITH {SCORED}, s AS (SELECT service_name, score, sum(truth) AS p, count(*) - sum(truth) AS q FROM scored GROUP BY ALL),
r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY service_name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower, sum(p) OVER (PARTITION BY service_name ORDER BY score DESC) AS tp, sum(p + q) OVER (PARTITION BY service_name ORDER BY score DESC) AS alln FROM s),
a AS (SELECT service_name, sum(p) FILTER (score > 40) AS tp, sum(q) FILTER (score > 40) AS fp, sum(p) FILTER (score <= 40) AS fn, sum(q) FILTER (score <= 40) AS tn, sum(p * (lower + q / 2)) AS u, sum(p * r.tp / alln) AS ap FROM r GROUP BY service_name),
z AS (SELECT service_name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, u, ap FROM a)
SELECT service_name, tp::BIGINT AS true_positive, fp::BIGINT AS false_positive, fn::BIGINT AS false_negative, tn::BIGINT AS true_negative, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS fpr, round(u / nullif((tp + fn) * (tn + fp), 0), 6) AS roc_auc, round(CASE WHEN tn + fp > 0 THEN ap / nullif(tp + fn, 0) END, 6) AS average_precision FROM z""")
def binary_metrics_by_service(spark, d):
    return anomaly.binary_metrics(scored(spark, d), "truth", "score", 40, ["service_name"])


@query(f"""WITH {SCORED}, b AS (SELECT run_id, service_name, max(score) AS score FROM scored GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, service_name) AS rk FROM b),
e AS (SELECT DISTINCT run_id, service_name FROM scored WHERE truth = 1), m AS (SELECT run_id, min(rk) AS best_rank FROM r SEMI JOIN e USING (run_id, service_name) GROUP BY run_id)
SELECT run_id, best_rank, (best_rank <= 1)::INT AS hit1, (best_rank <= 3)::INT AS hit3, round(1 / best_rank, 6) AS reciprocal FROM m""")
def localization(spark, d):
    s = scored(spark, d)
    return anomaly.localization(s, s.where("truth = 1").select("run_id", "service_name").distinct())


@query(f"""WITH {SCORED} SELECT metric_name, count(*) AS n, count(DISTINCT run_id) AS runs, round(avg((score > 40)::INT), 6) AS recall FROM scored GROUP BY metric_name""")
def scenario_recall(spark, d):
    return scored(spark, d).groupBy("metric_name").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"), F.round(F.avg((F.col("score") > 40).cast("int")), 6).alias("recall"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ts_us, service_name, event_id) AS rk, count(*) OVER (PARTITION BY run_id) AS eligible FROM scored)
SELECT run_id, count(*) AS used, max(score) AS score_max, min(score) AS score_min, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, any_value(eligible) AS eligible FROM r WHERE rk <= 3 GROUP BY run_id""")
def top3_aggregate(spark, d):
    return windows.top_windows(scored(spark, d), ["run_id"], "score", ["ts_us", "service_name", "event_id"])


@query("""WITH r AS (SELECT o_orderpriority AS t, CASE WHEN o_totalprice > 150000 THEN '1-URGENT' ELSE '5-LOW' END AS p FROM orders), c AS (SELECT t, p, count(*) AS n FROM r GROUP BY ALL),
j AS (SELECT coalesce(a.t, b.p) AS class, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(chosen, 0) AS chosen FROM (SELECT t, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS hit FROM c GROUP BY t) a FULL JOIN (SELECT p, sum(n) AS chosen FROM c GROUP BY p) b ON a.t = b.p),
k AS (SELECT *, coalesce(hit / nullif(chosen, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM j)
SELECT class, support::BIGINT AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM k""")
def multiclass_metrics(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("t"), F.when(F.col("o_totalprice") > 150000, "1-URGENT").otherwise("5-LOW").alias("p"))
    return anomaly.multiclass_metrics(rows, "t", "p")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_mktsegment || ':' || c_custkey)) AS place FROM customer)
SELECT c_custkey, c_mktsegment, place::INT AS place, CASE place WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'train' END AS split FROM r""")
def split_hash(spark, d):
    return anomaly.hash_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", "42").withColumn("place", F.col("place").cast("int"))


@query(f"""SELECT doc_id, len({TERMS_SQL})::BIGINT AS n_terms, len(list_distinct({TERMS_SQL}))::BIGINT AS n_distinct FROM documents""")
def tokenize_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(terms(F.col("text"))).cast("long").alias("n_terms"), F.size(F.array_distinct(terms(F.col("text")))).cast("long").alias("n_distinct"))


def _bm25(spark, d, k: int = 20):
    docs = table(spark, d, "documents").select("doc_id", terms(F.col("text")).alias("terms"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(terms(F.col("text"))).alias("term"))
    return retrieval.top_k(retrieval.bm25_best(docs, asked, k), "query_id", "doc_id", k)


BM25_SQL = f"""t AS (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents), po AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), le AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
n AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM le), ra AS (SELECT term, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, n GROUP BY term, docs), me AS (SELECT avg(raw) AS mean FROM ra),
idf AS (SELECT term, CASE WHEN raw < 0 THEN mean * 0.25 ELSE raw END AS idf FROM ra, me), qt AS (SELECT item_id AS query_id, unnest({TERMS_SQL}) AS term FROM benchmark), qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po JOIN qc USING (term) JOIN idf USING (term) JOIN le USING (doc_id), n GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc QUALIFY rank <= 20)"""


@query(f"WITH {BM25_SQL} SELECT * FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d)


def _dense(spark, d, k: int = 20):
    """Every vector as a candidate of the vectors whose id is divisible by 100; they stand for the benchmark's items in order."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.top_k(retrieval.cosine_best(q, v.withColumnRenamed("vec_id", "doc_id"), k), "query_id", "doc_id", k)


DENSE_SQL = """de AS (SELECT q.vec_id // 100 AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
 FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 20)"""


@query(f"WITH {DENSE_SQL} SELECT * FROM de")
def cosine_topk(spark, d):
    return _dense(spark, d)


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, j AS (SELECT coalesce(bm.query_id, de.query_id) AS query_id, coalesce(bm.doc_id, de.doc_id) AS doc_id, bm.rank AS r1, de.rank AS r2 FROM bm FULL JOIN de ON bm.query_id = de.query_id AND bm.doc_id = de.doc_id),
s AS (SELECT *, round(coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0), 9) AS score FROM j) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(r1, r2), doc_id)::INT AS rank FROM s""")
def rrf_fusion(spark, d):
    return retrieval.reciprocal_rank_fusion(_bm25(spark, d), _dense(spark, d), "query_id", "doc_id")


def _grades(spark, d):
    """Grades by rule: labelled documents are relevant to the items of their remainder by 5."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).alias("m"))
    g = table(spark, d, "labels").where("quality + toxic > 0").select("doc_id", (F.col("quality") + F.col("toxic")).alias("grade"), (F.col("doc_id") % 5).alias("m"))
    return items.join(g, "m").select("query_id", "doc_id", "grade")


GRADES_SQL = "gr AS (SELECT item_id AS query_id, doc_id, quality + toxic AS grade FROM labels JOIN benchmark ON item_id % 5 = doc_id % 5 WHERE quality + toxic > 0)"
_AT = ", ".join(f"round(coalesce(n{k} / relevant, 0), 6) AS recall_{k}, (coalesce(n{k}, 0) > 0)::INT AS hit_{k}" for k in (1, 3, 5, 10))


@query(f"""WITH {BM25_SQL}, {GRADES_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM gr), id AS (SELECT query_id, count(*) AS relevant, {", ".join(f"sum((2 ** grade - 1) / log2(r + 1)) FILTER (r <= {k}) AS i{k}" for k in (5, 10))} FROM i GROUP BY query_id),
f AS (SELECT query_id, min(rank) AS first, {", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}" for k in (1, 3, 5, 10))}, {", ".join(f"sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= {k}) AS d{k}" for k in (5, 10))} FROM bm JOIN gr USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, {_AT}, round(coalesce(1 / first, 0), 6) AS mrr_10, round(coalesce(d5 / i5, 0), 6) AS ndcg_5, round(coalesce(d10 / i10, 0), 6) AS ndcg_10 FROM id LEFT JOIN f USING (query_id)""")
def rank_metrics(spark, d):
    return retrieval.rank_metrics(_bm25(spark, d), _grades(spark, d))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, {GRADES_SQL}, q AS (SELECT item_id AS query_id FROM benchmark), a AS (SELECT DISTINCT query_id FROM bm SEMI JOIN gr USING (query_id, doc_id)), b AS (SELECT DISTINCT query_id FROM de SEMI JOIN gr USING (query_id, doc_id))
SELECT CASE WHEN a.query_id IS NOT NULL AND b.query_id IS NOT NULL THEN 'both' WHEN a.query_id IS NOT NULL THEN 'left_only' WHEN b.query_id IS NOT NULL THEN 'right_only' ELSE 'neither' END AS category, count(*) AS n FROM q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) GROUP BY 1""")
def complementarity(spark, d):
    g = _grades(spark, d)
    hit = lambda r: r.join(g, ["query_id", "doc_id"], "left_semi")
    return retrieval.complementarity(hit(_bm25(spark, d)), hit(_dense(spark, d)), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 400) / 340.0))::BIGINT + 1)) AS chunk_index FROM t WHERE len(w) >= 8),
x AS (SELECT doc_id, chunk_index, chunk_index * 340 AS first_token, w[chunk_index * 340 + 1 : chunk_index * 340 + 400] AS p FROM c) SELECT doc_id, chunk_index::INT AS chunk_index, first_token::INT AS first_token, len(p)::INT AS token_count, sha256(doc_id || '|' || chunk_index || '|' || array_to_string(p, ' ')) AS chunk_id FROM x""")
def chunk_windows(spark, d):
    return corpus.chunk_tokens(table(spark, d, "documents"), "doc_id", "text", 400, 60, 8).drop("content")


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\s+$', '') || chr(10)) AS checksum FROM documents""")
def doc_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(normal_text(F.col("text")), 256).alias("checksum"))


@query("""WITH g AS (SELECT source, sha256(text) AS h, count(*) AS c FROM documents GROUP BY ALL) SELECT source, sum(c)::BIGINT AS documents, count(*) AS distinct_documents, sum(c - 1)::BIGINT AS duplicates FROM g GROUP BY source""")
def corpus_quality(spark, d):
    return corpus.duplicates_by(table(spark, d, "documents").withColumn("h", F.sha2("text", 256)), "source", "h")


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), i AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN s.h IS NULL THEN 'inserted' WHEN i.h IS NULL THEN 'removed' WHEN s.h = i.h THEN 'skipped' ELSE 'updated' END AS action FROM s FULL JOIN i ON s.doc_id = i.doc_id""")
def changed_docs(spark, d):
    """Two versions of the corpus, made by rule from the whole table: the stored lacks every fifth document, the incoming every third, and has every seventh changed."""
    docs = table(spark, d, "documents")
    stored = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    incoming = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return corpus.changes(stored, incoming, "doc_id", "h")


@query("""WITH i AS (SELECT c_custkey + 100 AS c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer) SELECT * FROM i UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer ANTI JOIN i USING (c_custkey)""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return corpus.upsert(c, c.select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal")), "c_custkey")


@query("""SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def incident_filter_page(spark, d):
    """The third page of open orders with a large line, newest first."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return corpus.page(o.select("o_orderkey", "o_orderstatus", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 20)


@query("""SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS runs FROM orders GROUP BY o_custkey""")
def latest_run(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("runs"))


STATES = ("OPEN", "INVESTIGATING", "MITIGATED", "RESOLVED", "CLOSED")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_suppkey, ['OPEN','INVESTIGATING','MITIGATED','RESOLVED','CLOSED'][(l_suppkey % 5 + 1)::INT] AS state FROM lineitem), b AS (SELECT * EXCLUDE (l_suppkey), lag(state) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS before FROM e)
SELECT l_orderkey, l_linenumber, state, before, CASE WHEN before IS NULL THEN state = 'OPEN' ELSE before || '>' || state IN ('OPEN>INVESTIGATING','OPEN>RESOLVED','INVESTIGATING>MITIGATED','INVESTIGATING>RESOLVED','MITIGATED>INVESTIGATING','MITIGATED>RESOLVED','RESOLVED>INVESTIGATING','RESOLVED>CLOSED') END AS legal FROM b""")
def transition_legal(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, STATES)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("state"), "l_suppkey")
    return corpus.transitions(e, "l_orderkey", ["l_linenumber", "l_suppkey"], "state").drop("l_suppkey")


@query("""SELECT user_id || ':' || event_type AS request_key, arg_min(event_id, (ts, event_id)) AS winner, count(*) AS attempts FROM events GROUP BY 1""")
def claim_idempotent(spark, d):
    e = table(spark, d, "events").withColumn("request_key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return corpus.claims(e, "request_key", ["ts", "event_id"])


@query(r"""WITH c AS (SELECT conv_id, list(turn) FILTER (role = 'assistant') AS a, list(turn) FILTER (length(text) > 100) AS b FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, coalesce(list_distinct(a), []) AS a, coalesce(list_distinct(b), []) AS b FROM c)
SELECT conv_id, len(a)::INT AS n_cited, len(b)::INT AS n_gold, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0), 6) AS precision, round(coalesce(len(list_intersect(a, b)) / nullif(len(b), 0), 0), 6) AS recall FROM n""")
def citation_pr(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"), F.collect_set(F.when(F.length("text") > 100, F.col("turn"))).alias("b"))
    return answers.citation_scores(c, "conv_id", "a", "b")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS ra, count(*) FILTER (quality = 1 AND toxic <> 0) AS wab, count(*) FILTER (quality <> 1 AND toxic = 0) AS wa, count(*) FILTER (quality <> 1 AND toxic <> 0) AS rab FROM labels)
SELECT ra AS right_answer, wab AS wrong_abstention, wa AS wrong_answer, rab AS right_abstention, round(rab / nullif(rab + wab, 0), 6) AS abstention_precision, round(rab / nullif(rab + wa, 0), 6) AS abstention_recall, round(wa / nullif(wa + rab, 0), 6) AS unsupported_rate, round(wab / nullif(wab + ra, 0), 6) AS refusal_rate FROM c""")
def abstention_confusion(spark, d):
    return answers.abstention(table(spark, d, "labels").select((F.col("quality") == 1).alias("e"), (F.col("toxic") == 0).alias("g")), "e", "g")


@query(f"""WITH {OBS_SQL} SELECT metric_name, count(numeric_value) AS n, round(avg(numeric_value), 6) AS mean, min(numeric_value) AS min, max(numeric_value) AS max, round(quantile_cont(numeric_value, 0.5), 6) AS p50, round(quantile_cont(numeric_value, 0.95), 6) AS p95, round(quantile_cont(numeric_value, 0.99), 6) AS p99 FROM obs GROUP BY metric_name""")
def distribution(spark, d):
    return windows.distribution(observations(spark, d), ["metric_name"], "numeric_value")


@query("""WITH c AS (SELECT l_orderkey, sum((l_returnflag = 'R')::INT) AS h, count(*) AS n FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderpriority, h, n FROM c JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS cases, round(sum(h) / sum(n), 6) AS micro, round(avg(h / n), 6) AS macro FROM o GROUP BY o_orderpriority""")
def micro_macro_groups(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("h"), F.count("*").alias("n"))
    return answers.micro_macro(c.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")), "o_orderpriority", "h", "n")


DLQ_SQL = """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'metrics' WHEN 1 THEN 'logs' WHEN 2 THEN 'traces' ELSE 'profiles' END AS signal, CASE event_id % 5 WHEN 1 THEN '[' || props || ']' WHEN 2 THEN props || '}' ELSE props END AS v FROM events)
SELECT event_id, CASE WHEN signal = 'profiles' THEN 'unsupported_signal' WHEN NOT json_valid(v) THEN 'invalid_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_an_object' END AS error FROM r"""


@query(DLQ_SQL)
def dlq_route(spark, d):
    """Events as raw messages, some of them damaged by rule, with their verdict."""
    v = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 5 == 2, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    signal = F.element_at(F.array(*map(F.lit, ("metrics", "logs", "traces", "profiles"))), (F.col("event_id") % 4 + 1).cast("int"))
    raw = table(spark, d, "events").select("event_id", signal.alias("signal"), v.cast("binary").alias("value"))
    return route.validate(raw, "value", "signal").select("event_id", "error")


@query(f"""WITH {OBS_SQL} SELECT service_name, metric_name, count(*) AS n, round(sum(numeric_value), 4) AS total, min(ts_us * 1000) AS first_ns FROM obs GROUP BY ALL""")
def otlp_round_trip(spark, d):
    """Events written as OTLP JSON lines, one for each, and read back as metric observations."""
    o = observations(spark, d)
    point = F.struct(F.array(F.struct(F.lit("series").alias("key"), F.struct(F.col("series").cast("string").alias("stringValue")).alias("value"))).alias("attributes"), (F.col("ts_us") * 1000).cast("string").alias("timeUnixNano"), F.col("numeric_value").alias("asDouble"))
    metric = F.struct(F.col("metric_name").alias("name"), F.lit("1").alias("unit"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    resource = F.struct(F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service_name").alias("stringValue")).alias("value"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))
    lines = o.select(F.to_json(F.struct(F.array(resource).alias("resourceMetrics"))).alias("line"))
    return otlp.metric_observations(lines).groupBy("service_name", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("numeric_value"), 4).alias("total"), F.min("timestamp_ns").alias("first_ns"))


@query()
def bootstrap_ci(spark, d):
    """Rows only: resampling weights come from numpy's generator."""
    return answers.bootstrap(table(spark, d, "labels").select("doc_id", "quality"), "quality", resamples=10_000)


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + INTERVAL 2 hour <= (SELECT max(ts) FROM events) GROUP BY start, event_type""")
def stream_tumbling(spark, d):
    """Events as a file stream into hourly windows that a watermark of one hour closes, all available input at once: the windows that end an hour before the last event."""
    from pyspark.sql.types import StructType

    schema: StructType = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    at = folder(spark, "stream")
    out = route.closed_windows(stream, "ts", ["event_type"], "value", 3600, "1 hour")
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/windows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/windows").withColumn("total", F.round("total", 4))
