"""Queries over a knowledge corpus and answers, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import knowledge, retrieval
from vigil.plans.catalog import BM25_SQL, DENSE_SQL, _bm25, _dense, query
from vigil.sources.tables import table

KINDS, SERVICES, INCIDENTS = ["guide", "runbook", "postmortem"], ["api", "cart", "search"], ["latency", "outage"]
FIELDS = ["title", "document_type", "version", "services", "incident_types", "synthetic"]
#: Documents as Markdown by rule: metadata damaged by remainders, and the text, in one line, below two headings, its beginning again below a third.
MARKDOWN_SQL = r"""md AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS line FROM documents)"""


def _markdown(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("line"))
    i = F.col("doc_id")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    head = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: Note "), i.cast("string")), F.concat(F.lit("document_type: "), F.when(i % 19 == 0, "novel").otherwise(pick(KINDS))), F.when(i % 13 != 0, F.concat(F.lit("version: "), (i % 4).cast("string"))),
        F.concat(F.lit("services: ["), pick(SERVICES), F.lit(", api, "), pick(SERVICES), F.lit("]")), F.lit("incident_types: [latency]"), F.lit("synthetic: true  "), F.when(i % 17 == 0, "author: x"), F.when(i % 11 != 0, F.lit("---")),
    )
    body = F.concat_ws("\n", F.lit("# Top"), F.lit("### Deep"), F.col("line"), F.lit("## Side  "), F.substring("line", 1, 300), F.lit(""))
    return docs.select("doc_id", F.concat(head, F.lit("\r\n\n"), body).alias("text"))


@query(r"""WITH d AS (SELECT doc_id AS i, ['guide','runbook','postmortem'][(doc_id % 3 + 1)::INT] AS k, ['api','cart','search'][(doc_id % 3 + 1)::INT] AS s FROM documents)
SELECT i AS doc_id, CASE WHEN i % 11 = 0 THEN 'unclosed' END AS error, CASE WHEN i % 11 <> 0 THEN 'Note ' || i END AS title, CASE WHEN i % 11 <> 0 THEN array_to_string(list_distinct_ordered, ',') END AS services,
 CASE WHEN i % 11 <> 0 THEN array_to_string(list_sort(CASE WHEN i % 13 = 0 THEN ['missing:version'] ELSE [] END || CASE WHEN i % 13 <> 0 AND i % 4 = 0 THEN ['version'] ELSE [] END || CASE WHEN i % 17 = 0 THEN ['unknown:author'] ELSE [] END || CASE WHEN i % 19 = 0 THEN ['document_type'] ELSE [] END), ',') END AS reasons
FROM (SELECT *, CASE WHEN s = 'api' THEN ['api'] ELSE [s, 'api'] END AS list_distinct_ordered FROM d)""")
def front_matter(spark, d):
    """Metadata of Markdown documents and the reasons for which they are rejected."""
    m = knowledge.front_matter(_markdown(spark, d))
    reasons = knowledge.metadata_errors(F.col("head"), FIELDS, KINDS, {"services": SERVICES, "incident_types": INCIDENTS})
    return m.select("doc_id", "error", knowledge.value_of(F.col("head"), "title").alias("title"), F.array_join(knowledge.list_of(F.col("head"), "services"), ",").alias("services"), F.when(F.col("error").isNull(), F.array_join(reasons, ",")).alias("reasons"))


_SECTIONS_SQL = f"""{MARKDOWN_SQL}, se AS (SELECT doc_id, 0 AS section, 'Top > Deep' AS heading, line AS text FROM md WHERE line <> '' AND doc_id % 11 <> 0 UNION ALL SELECT doc_id, 1, 'Top > Side', trim(substr(line, 1, 300), ' ') FROM md WHERE line <> '' AND doc_id % 11 <> 0)"""


@query(f"WITH {_SECTIONS_SQL} SELECT doc_id, section, heading, sha256(text) AS digest FROM se")
def markdown_sections(spark, d):
    return knowledge.sections(knowledge.front_matter(_markdown(spark, d)), "doc_id").select("doc_id", "section", "heading", F.sha2("text", 256).alias("digest"))


@query(rf"""WITH {_SECTIONS_SQL}, b AS (SELECT doc_id, sha256('# Top' || chr(10) || '### Deep' || chr(10) || line || chr(10) || '## Side' || chr(10) || regexp_replace(substr(line, 1, 300), '[ \t]+$', '') || chr(10)) AS checksum FROM md),
t AS (SELECT doc_id, section, heading, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS t FROM se), c AS (SELECT *, unnest(range(0, greatest(0, ceil((len(t) - 64) / 48.0))::BIGINT + 1)) AS i FROM t WHERE len(t) >= 8),
p AS (SELECT doc_id, section, heading, i, len(t[i * 48 + 1 : i * 48 + 64]) AS token_count, trim(regexp_replace(array_to_string(t[i * 48 + 1 : i * 48 + 64], ' '), '\s+([,.;:!?%)\]])', '\1', 'g'), ' ') AS content FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, i) - 1 AS chunk_index FROM p)
SELECT doc_id, chunk_index::INT AS chunk_index, heading, token_count::INT AS token_count, sha256(doc_id || chr(0) || checksum || chr(0) || '1' || chr(0) || chunk_index || chr(0) || heading || chr(0) || content) AS chunk_id FROM n JOIN b USING (doc_id)""")
def section_chunks(spark, d):
    """Chunks of sections, with identities over document, checksum, place, heading and content."""
    docs = knowledge.front_matter(_markdown(spark, d)).select("doc_id", "body", F.sha2("body", 256).alias("checksum"))
    return knowledge.section_chunks(docs, "doc_id", "checksum", 64, 16).drop("content")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, 'E' || rank AS evidence_id FROM bm WHERE rank <= 5")
def evidence_pack(spark, d):
    return knowledge.evidence_pack(_bm25(spark, d, 20), "query_id", 5).select("query_id", "doc_id", "rank", "evidence_id")


@query(r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens FROM conversations), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t) SELECT conv_id, turn, tokens::INT AS tokens, used FROM u WHERE used <= 120""")
def fit_context(spark, d):
    """Turns of a conversation as evidence in order, as far as they fit into 120 tokens."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.size(knowledge.word_tokens(F.col("text"))).alias("tokens"))
    return knowledge.fit_context(t, "conv_id", "turn", "tokens", 120)


_REASONS = ("", "duplicate_citation", "citation_claim_mismatch", "unknown_evidence_id", "source_path_mismatch", "heading_path_mismatch", "grounded_without_citation", "insufficient_with_citation")


@query(f"""SELECT reasons, count(*) AS n, reasons = '' AS valid FROM (SELECT {list(_REASONS)}[((conv_id + turn) % 8 + 1)::INT] AS reasons FROM conversations) GROUP BY reasons""")
def structural_citations(spark, d):
    """Answers, each broken in another way by rule, with the reasons found."""
    one = lambda i, p, h: F.struct(F.lit(i).alias("id"), F.lit(p).alias("path"), F.lit(h).alias("heading"))
    good = [one(f"E{i}", f"doc/{i}", f"H{i}") for i in range(1, 6)]
    r = (F.col("conv_id") + F.col("turn")) % 8
    none = F.expr("cast(array() as array<struct<id: string, path: string, heading: string>>)")
    cites = F.when(r == 0, F.array(good[0], good[1])).when(r == 1, F.array(good[0], good[0])).when(r == 3, F.array(one("E9", "doc/9", "H9"))).when(r == 4, F.array(one("E1", "doc/x", "H1"))).when(r == 5, F.array(one("E1", "doc/1", "Hx"))).when(r == 6, none).otherwise(F.array(good[0]))
    claims = F.when(r == 0, F.array(F.lit("E2"), F.lit("E1"))).when(r == 2, F.array(F.lit("E2"))).when(r == 3, F.array(F.lit("E9"))).when(r == 6, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("E1")))
    status = F.when(r == 7, "insufficient_evidence").otherwise("grounded")
    reasons = F.array_join(knowledge.structural_reasons(status, cites, claims, F.array(*good)), ",")
    return table(spark, d, "conversations").select(reasons.alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n")).withColumn("valid", F.col("reasons") == "")


_ERRORS = ("valid", "invalid_schema", "insufficient_with_claims", "grounded_without_claims", "claim_without_evidence", "unknown_evidence", "duplicate_citation", "citations_not_exact")
_ANSWERS = (
    '{"status":"grounded","summary":"s","suspected_causes":[{"evidence":["E1"]}],"recommended_actions":[{"evidence":["E2"]}],"citations":[{"evidence_id":"E1"},{"evidence_id":"E2"}]}', '{"status":',
    '{"status":"insufficient_evidence","citations":[{"evidence_id":"E1"}]}', '{"status":"grounded","suspected_causes":[{"evidence":["E1"]}],"citations":[{"evidence_id":"E1"}]}',
    '{"status":"grounded","suspected_causes":[{"evidence":[]}],"recommended_actions":[{"evidence":["E1"]}],"citations":[{"evidence_id":"E1"}]}', '{"status":"grounded","suspected_causes":[{"evidence":["E1"]}],"recommended_actions":[{"evidence":["E7"]}],"citations":[{"evidence_id":"E1"}]}',
    '{"status":"grounded","suspected_causes":[{"evidence":["E1"]}],"recommended_actions":[{"evidence":["E1"]}],"citations":[{"evidence_id":"E1"},{"evidence_id":"E1"}]}', '{"status":"grounded","suspected_causes":[{"evidence":["E1"]}],"recommended_actions":[{"evidence":["E2"]}],"citations":[{"evidence_id":"E1"}]}',
)


@query(f"""SELECT conv_id, turn, {list(_ERRORS)}[((conv_id + turn) % 8 + 1)::INT] AS verdict FROM conversations""")
def answer_validation(spark, d):
    """Answers as JSON text, by rule one of eight, with the first rule that they break."""
    text = F.element_at(F.array(*map(F.lit, _ANSWERS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    known = F.array(*(F.lit(f"E{i}") for i in range(1, 6)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(knowledge.answer_error(text, known), F.lit("valid")).alias("verdict"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' We have restarted it.' ELSE '' END || CASE WHEN conv_id % 6 = 0 THEN ' zx-SENTINEL-9' ELSE '' END AS a FROM conversations),
r AS (SELECT conv_id, turn, role, array_to_string(CASE WHEN turn % 4 = 3 THEN ['expected_status_not_preserved'] ELSE [] END || CASE WHEN conv_id % 9 = 0 THEN ['invalid_citation_behavior'] ELSE [] END || CASE WHEN contains(lower(a), 'zx-sentinel-9') THEN ['sentinel_disclosure'] ELSE [] END
 || CASE WHEN regexp_matches(a, '(?i)\b(?:i|we)\s+(?:have\s+)?(?:executed|ran|restarted|terminated|changed|scaled|rolled back)\b') THEN ['claimed_action_execution'] ELSE [] END || CASE WHEN conv_id % 10 = 1 THEN ['factual_answer_not_nli_supported'] ELSE [] END, ',') AS reasons FROM c)
SELECT role, reasons, count(*) AS n FROM r GROUP BY role, reasons""")
def adversarial_verdicts(spark, d):
    """Answers to tampered cases, with the reasons for which they fail, and how often."""
    c, t = F.col("conv_id"), F.col("turn")
    answer = F.concat("text", F.when((c + t) % 5 == 0, " We have restarted it.").otherwise(""), F.when(c % 6 == 0, " zx-SENTINEL-9").otherwise(""))
    reasons = knowledge.adversarial_reasons(F.when(t % 4 == 3, "grounded").otherwise("insufficient_evidence"), F.lit("insufficient_evidence"), c % 9 != 0, answer, F.lit("ZX-sentinel-9"), c % 10 != 1)
    return table(spark, d, "conversations").select("role", F.array_join(reasons, ",").alias("reasons")).groupBy("role", "reasons").agg(F.count("*").alias("n"))


@query(f"""WITH {BM25_SQL}, rk AS (SELECT query_id, (doc_id % 60)::VARCHAR AS key, rank FROM bm), go AS (SELECT item_id AS query_id, k::VARCHAR AS key, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS grade FROM benchmark, range(0, 60) t(k) WHERE (k + item_id) % 6 = 0),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, key) AS r FROM go), id AS (SELECT query_id, count(*) AS relevant, sum((2 ** grade - 1) / log2(r + 1)) FILTER (r <= 5) AS ideal FROM i GROUP BY query_id),
f AS (SELECT query_id, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, {", ".join(f"count(DISTINCT key) FILTER (rank <= {k}) AS n{k}" for k in (1, 3, 5))} FROM rk JOIN go USING (query_id, key) WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, {", ".join(f"round(coalesce(n{k} / relevant, 0), 6) AS recall_{k}, (coalesce(n{k}, 0) > 0)::INT AS hit_{k}" for k in (1, 3, 5))}, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM id LEFT JOIN f USING (query_id)""")
def section_metrics(spark, d):
    """Retrieval by sections: documents of one remainder by 60 stand for one section."""
    ranked = _bm25(spark, d).select("query_id", (F.col("doc_id") % 60).cast("string").alias("key"), "rank")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k")).where((F.col("k") + F.col("query_id")) % 6 == 0)
    return knowledge.section_metrics(ranked, items.select("query_id", F.col("k").cast("string").alias("key"), F.when(F.col("k") % 2 == 0, 2).otherwise(1).alias("grade")))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, j AS (SELECT coalesce(bm.query_id, de.query_id) AS query_id, coalesce(bm.doc_id, de.doc_id) AS doc_id, bm.rank AS r1, de.rank AS r2 FROM bm FULL JOIN de ON bm.query_id = de.query_id AND bm.doc_id = de.doc_id),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0), 9) DESC, least(r1, r2), doc_id)::INT AS rrf_rank FROM j), c AS (SELECT query_id, doc_id, rrf_rank, substr(sha256(query_id || ':' || doc_id), 1, 2) AS grade FROM s WHERE rrf_rank <= 10)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rrf_rank, doc_id)::INT AS rank FROM c""")
def reranked(spark, d):
    """The ten best of both branches in the order of another score, here two digits of a hash, ties by the rank before."""
    f = retrieval.reciprocal_rank_fusion(_bm25(spark, d), _dense(spark, d), "query_id", "doc_id").where("rank <= 10")
    c = f.select("query_id", "doc_id", F.col("rank").alias("rrf_rank"), F.substring(F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id").cast("string")), 256), 1, 2).alias("grade"))
    return knowledge.rerank(c, "query_id", "grade", "rrf_rank", "doc_id")


@query(f"""WITH {BM25_SQL}, l AS (SELECT query_id, any_value(b.item_id % 3) AS style, max((d.lang = 'en')::INT) AS hit FROM benchmark b LEFT JOIN bm ON item_id = query_id LEFT JOIN documents d USING (doc_id) WHERE query_id IS NOT NULL GROUP BY query_id)
SELECT style, count(*) AS cases, round(avg(hit), 6) AS hit_rate FROM l GROUP BY style""")
def filter_cases(spark, d):
    """How many cases of a filter (language) find a hit that passes it, by style."""
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    per = hits.groupBy("query_id").agg(F.max((F.col("lang") == "en").cast("int")).alias("hit"))
    return per.groupBy((F.col("query_id") % 3).alias("style")).agg(F.count("*").alias("cases"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("""WITH c AS (SELECT vec_id AS doc_id, embedding FROM embeddings WHERE vec_id % 7 <> 0), d AS (SELECT doc_id, doc_id % 9 <> 0 AS active FROM documents WHERE doc_id % 10 <> 3),
n AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 63 ELSE len(embedding) END <> 64 AS bd, NOT sqrt(list_sum(list_transform(embedding, lambda x: CASE WHEN doc_id % 40 = 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * x * x)) - CASE WHEN doc_id % 50 = 1 THEN (embedding[64]::DOUBLE) ** 2 * CASE WHEN doc_id % 40 = 2 THEN 1.1 ELSE 1 END ELSE 0 END) BETWEEN 0.999 AND 1.001 AS bn FROM c)
SELECT (SELECT count(*) FROM n) AS chunks, (SELECT count(*) FROM d WHERE active) AS active_documents, (SELECT count(*) FROM n WHERE bd) AS wrong_dimension, (SELECT count(*) FROM n WHERE bn) AS wrong_norm, (SELECT count(*) FROM n ANTI JOIN d USING (doc_id)) AS orphans, (SELECT count(*) FROM d ANTI JOIN c USING (doc_id) WHERE active) AS uncovered""")
def store_checks(spark, d):
    """Vectors as chunks of the documents of their number, some damaged by rule."""
    v = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 40 == 2, F.lit(1.1**0.5)).otherwise(F.lit(1.0)))
    c = table(spark, d, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 50 == 1, F.slice(v, 1, 63)).otherwise(v).alias("embedding"))
    docs = table(spark, d, "documents").where("doc_id % 10 <> 3").select("doc_id", (F.col("doc_id") % 9 != 0).alias("active"))
    return knowledge.store_checks(c, docs, "doc_id", "embedding", "active", 64)


@query(r"""WITH p AS (SELECT page_id, ['docs/', 'data/raw/', '.git/', 'a/models/', 'x/y/'][(page_id % 5 + 1)::INT] || 'p' || page_id || ['.md', '.TXT', '.html'][(page_id % 3 + 1)::INT] AS path FROM pages) SELECT page_id, path, regexp_matches(lower(path), '\.(md|txt)$') AND page_id % 5 IN (0, 4) AS supported FROM p""")
def supported_paths(spark, d):
    """Which files a corpus scan takes; paths by rule."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % len(xs) + 1).cast("int"))
    path = F.concat(pick(("docs/", "data/raw/", ".git/", "a/models/", "x/y/")), F.lit("p"), F.col("page_id").cast("string"), pick((".md", ".TXT", ".html")))
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("supported", knowledge.supported_path(F.col("path")))
