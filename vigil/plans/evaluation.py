"""Queries over judged answers, stand-in embeddings and scores, and rankings of classes, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import answers, evaluation
from vigil.plans.catalog import query
from vigil.sources.tables import table

#: Turns as answers, by rule: up to three claims, some marked, on evidence made of the turn.
_ANSWERS_SQL = """a AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 5 = 0 THEN 'insufficient_evidence' ELSE 'grounded' END AS status, CASE WHEN turn % 4 = 3 THEN 0 ELSE 2 END AS cited, role || CASE WHEN turn % 6 = 1 THEN ' NEUTRAL' ELSE '' END AS summary,
 [struct_pack(kind := CASE WHEN k = 2 THEN 'action' ELSE 'cause' END, text := role || ' ' || k || ['', ' CONTRADICTION', ' NEUTRAL', ''][((conv_id + k) % 4 + 1)::INT], two := k <> 2) FOR k IN range(1, turn % 4 + 1)] AS claims FROM conversations)"""
_LABEL = "CASE WHEN contains({0}, 'CONTRADICTION') THEN 'contradiction' WHEN contains({0}, 'NEUTRAL') THEN 'neutral' ELSE 'entailment' END"
_WORDS = r"len(regexp_extract_all({0}, '\S+'))"


def _answers(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    marks = F.array(*map(F.lit, ("", " CONTRADICTION", " NEUTRAL", "")))
    claim = lambda k: F.struct(F.when(k == 2, "action").otherwise("cause").alias("kind"), F.concat(F.col("role"), F.lit(" "), k.cast("string"), F.element_at(marks, ((c + k) % 4 + 1).cast("int"))).alias("text"), F.when(k == 2, F.array(F.lit("E2"))).otherwise(F.array(F.lit("E1"), F.lit("E2"))).alias("evidence"))
    claims = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k <= t % 4), claim)
    entry = lambda i, x: F.struct(F.lit(i).alias("id"), x.alias("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", "role", "text", F.when(c % 5 == 0, "insufficient_evidence").otherwise("grounded").alias("status"), F.concat("role", F.when(t % 6 == 1, " NEUTRAL").otherwise("")).alias("summary"),
        claims.alias("claims"), F.when(t % 4 == 3, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("E1"), F.lit("E2"))).alias("citations"), F.array(entry("E1", F.col("text")), entry("E2", F.col("role"))).alias("evidence"),
    )


@query(rf"""WITH {_ANSWERS_SQL}, j AS (SELECT *, [struct_pack(l := {_LABEL.format("x.text")}, w := {_WORDS.format("x.text")} + {_WORDS.format("role")} + CASE WHEN x.two THEN {_WORDS.format("text")} ELSE 0 END) FOR x IN claims] AS r, CASE WHEN status = 'grounded' AND cited > 0 THEN {_LABEL.format("summary")} END AS s,
 {_WORDS.format("summary")} + {_WORDS.format("role")} + {_WORDS.format("text")} AS sw FROM a), n AS (SELECT *, len(r) AS n, len([x FOR x IN r IF x.l = 'entailment']) AS e, len([x FOR x IN r IF x.l = 'contradiction']) AS c, len([x FOR x IN r IF x.l = 'neutral']) AS u FROM j)
SELECT conv_id, turn, n::INT AS claim_count, e::INT AS supported, c::INT AS contradicted, u::INT AS neutral, round(e / nullif(n, 0), 6) AS supported_rate, round((c + u) / nullif(n, 0), 6) AS unsupported_rate, s AS summary_label, (n + (s IS NOT NULL)::INT)::INT AS pairs,
 (len([x FOR x IN r IF x.w > 40]) + CASE WHEN s IS NOT NULL AND sw > 40 THEN 1 ELSE 0 END)::INT AS truncated FROM n""")
def claim_support(spark, d):
    """Which claims of an answer their evidence supports, by the stand-in judge."""
    s = evaluation.claim_support(*map(F.col, ("status", "summary", "claims", "citations", "evidence")), evaluation.marked_judge(40))
    f = lambda n: F.round(F.col(f"s.{n}"), 6).alias(n)
    return _answers(spark, d).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.claim_count", "s.supported", "s.contradicted", "s.neutral", f("supported_rate"), f("unsupported_rate"), "s.summary_label", "s.pairs", "s.truncated")


@query(f"""WITH {_ANSWERS_SQL}, x AS (SELECT role, [y.text FOR y IN claims IF y.kind = 'cause'] AS f, [y.text FOR y IN claims IF y.kind = 'action'] AS g FROM a WHERE status <> 'insufficient_evidence'),
h AS (SELECT role, len(f) AS fn, len(g) AS gn, len([y FOR y IN f IF {_LABEL.format("y")} = 'entailment']) AS fh, len([y FOR y IN g IF {_LABEL.format("y")} = 'entailment']) AS gh FROM x)
SELECT role, count(*) AS cases, sum(fn)::BIGINT AS facts, sum(fh)::BIGINT AS covered, round(avg(coalesce(fh / nullif(fn, 0), 0)), 6) AS fact_coverage, round(avg(coalesce(gh / nullif(gn, 0), 0)), 6) AS action_coverage, round(sum(fh) / nullif(sum(fn), 0), 6) AS micro_coverage FROM h GROUP BY role""")
def completeness(spark, d):
    """Coverage of expected facts and actions, here an answer's own claims, by role; cases that should abstain are left out."""
    pick = lambda kind: F.transform(F.filter("claims", lambda c: c["kind"] == kind), lambda c: c["text"])
    x = evaluation.completeness(F.col("status"), evaluation.answer_text(F.col("summary"), F.col("claims")), pick("cause"), pick("action"), evaluation.marked_judge())
    r = _answers(spark, d).select("role", x.alias("x")).where("x is not null").select("role", "x.*")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return r.groupBy("role").agg(F.count("*").alias("cases"), F.sum("fact_count").alias("facts"), F.sum("covered_facts").alias("covered"), mean("fact_coverage"), mean("action_coverage"), F.round(F.try_divide(F.sum("covered_facts"), F.sum("fact_count")), 6).alias("micro_coverage"))


_VECTOR = "[(('0x' || h)::INT - 127.5::DOUBLE) / 127.5 FOR h IN regexp_extract_all(sha256('0:' || {0}), '..')][1:8]"


@query(f"""SELECT doc_id, round(v[1] / n, 9) AS first, round(v[8] / n, 9) AS last, round(list_sum([x / n FOR x IN v]), 6) AS total FROM (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM (SELECT doc_id, {_VECTOR.format("text")} AS v FROM documents))""")
def hashed_vectors(spark, d):
    """Stand-in embeddings of whole texts."""
    v = table(spark, d, "documents").select("doc_id", evaluation.hashed_vector(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[7], 9).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH {_ANSWERS_SQL}, q AS (SELECT conv_id, turn, CASE WHEN status = 'grounded' THEN {_VECTOR.format(f"'{evaluation.INSTRUCTION}' || text")} END AS v, {_VECTOR.format(f"'{evaluation.INSTRUCTION}' || summary")} AS w, ('0x' || substr(sha256(role || chr(0) || text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE AS s FROM a)
SELECT conv_id, turn, round(list_sum([v[i] * w[i] FOR i IN range(1, 9)]) / sqrt(list_sum([x * x FOR x IN v])) / sqrt(list_sum([x * x FOR x IN w])), 6) AS similarity, round(s, 9) AS score FROM q""")
def answer_similarity(spark, d):
    """Likeness of question and answer by stand-in embeddings, for grounded answers, and the stand-in score of a reranker."""
    s = evaluation.similarity(F.col("status"), F.col("text"), F.col("summary"))
    return _answers(spark, d).select("conv_id", "turn", F.round(s, 6).alias("similarity"), F.round(evaluation.hashed_score(F.col("role"), F.col("text")), 9).alias("score"))


@query("""WITH c AS (SELECT doc_id, ['grounded','insufficient','adversarial'][(doc_id % 3 + 1)::INT] AS kind, doc_id % 4 > 0 AS hit, (doc_id % 7) / 7 AS gain, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5) / 5 END AS again, CASE WHEN doc_id % 11 = 0 THEN 'invalid_schema' WHEN doc_id % 13 = 0 THEN 'timeout' END AS error,
 CASE WHEN doc_id % 13 = 0 THEN NULL WHEN quality = 1 THEN 'grounded' ELSE 'insufficient_evidence' END AS observed, CASE WHEN doc_id % 9 = 0 THEN 'insufficient_evidence' ELSE 'grounded' END AS expected, doc_id % 8 <> 1 AS valid, CASE WHEN doc_id % 6 < 4 THEN (doc_id % 6) / 6 END AS rate, CASE WHEN doc_id % 9 > 0 THEN (doc_id % 10) / 9 END AS cover, doc_id % 5 <> 2 AS passed FROM labels),
f AS (SELECT *, error IS NOT NULL OR observed IS NULL AS bad FROM c), r AS (SELECT list_sort(list_filter([CASE WHEN kind = 'grounded' AND NOT hit THEN 'retrieval_miss' END, CASE WHEN kind = 'grounded' AND again < gain THEN 'reranking_regression' END, CASE WHEN error = 'invalid_schema' THEN 'schema_failure' END,
 CASE WHEN bad AND error IS DISTINCT FROM 'invalid_schema' THEN 'generation_failure' END, CASE WHEN NOT bad AND observed <> expected THEN CASE WHEN observed = 'grounded' THEN 'false_grounded_answer' ELSE 'false_abstention' END END, CASE WHEN NOT bad AND NOT valid THEN 'incorrect_citation' END, CASE WHEN NOT bad AND rate > 0 THEN 'unsupported_claim' END,
 CASE WHEN NOT bad AND cover < 1 THEN 'missing_gold_fact' END, CASE WHEN kind = 'adversarial' AND (bad OR NOT passed) THEN 'prompt_injection_failure' END], lambda x: x IS NOT NULL)) AS l FROM f)
SELECT array_to_string(l, ',') AS categories, count(*) AS n FROM r GROUP BY 1""")
def failure_categories(spark, d):
    """All failures of a case; cases are labelled documents, with results by rule."""
    i = F.col("doc_id")
    case = {
        "kind": F.element_at(F.array(F.lit("grounded"), F.lit("insufficient"), F.lit("adversarial")), (i % 3 + 1).cast("int")), "hit": (i % 4 > 0).cast("int"), "gain": (i % 7) / 7, "reranked_gain": F.when(i % 2 == 0, (i % 5) / 5),
        "error": F.when(i % 11 == 0, "invalid_schema").when(i % 13 == 0, "timeout"), "observed": F.when(i % 13 == 0, None).when(F.col("quality") == 1, "grounded").otherwise("insufficient_evidence"),
        "expected": F.when(i % 9 == 0, "insufficient_evidence").otherwise("grounded"), "citations_valid": i % 8 != 1, "unsupported_rate": F.when(i % 6 < 4, (i % 6) / 6), "fact_coverage": F.when(i % 9 > 0, (i % 10) / 9), "passed": i % 5 != 2,
    }
    return table(spark, d, "labels").select(F.array_join(evaluation.failure_categories(case), ",").alias("categories")).groupBy("categories").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, ['a','b','c'][(user_id % 3 + 1)::INT] AS t, event_id % 7 + 1 AS a, event_id % 5 + 1 AS b, event_id % 3 + 1 AS c FROM events), p AS (SELECT t, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS p, CASE t WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END AS k FROM e),
x AS (SELECT n, t = n AS y, p[k2] AS s FROM p, (VALUES ('a', 1), ('b', 2), ('c', 3)) v(n, k2)), g AS (SELECT n, s, count(*) FILTER (y) AS u, count(*) FILTER (NOT y) AS w FROM x GROUP BY n, s), h AS (SELECT n, u, w, coalesce(sum(w) OVER (PARTITION BY n ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM g),
r AS (SELECT n, sum(u * (lower + w / 2)) / (sum(u) * sum(w)) AS auc FROM h GROUP BY n)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg((len([i FOR i IN range(1, 4) IF p[i] > p[k] OR (p[i] = p[k] AND i > k)]) < 2)::INT), 6) FROM p) AS top_2_accuracy, (SELECT round(avg(auc), 5) FROM r) AS roc_auc_macro""")
def class_ranking(spark, d):
    """Classes of events against probabilities made by rule."""
    e = table(spark, d, "events").select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int")).alias("t"), *((F.col("event_id") % m + 1).alias(n) for n, m in (("a", 7), ("b", 5), ("c", 3))))
    total = F.col("a") + F.col("b") + F.col("c")
    r = evaluation.class_ranking(e, "t", {n: F.col(n) / total for n in "abc"})
    return r.select("n", F.round("top_2_accuracy", 6).alias("top_2_accuracy"), F.round("roc_auc_macro", 5).alias("roc_auc_macro"))


@query()
def paired_interval(spark, d):
    """Rows only: interval of the mean difference of two variants of an order's mean quantity; resampling weights come from hashes."""
    t = table(spark, d, "lineitem").withColumn("v", F.col("l_quantity").cast("double"))
    one = lambda c, n: t.where(c).groupBy("l_orderkey").agg(F.avg("v").alias(n))
    pairs = one("l_linenumber <= 3", "a").join(one("l_linenumber >= 2", "b"), "l_orderkey")
    return answers.bootstrap(pairs.select("l_orderkey", (F.col("a") - F.col("b")).alias("difference")), "difference", resamples=1000)
