"""Support of claims, coverage of expected facts, failure categories of cases, and ranking measures of classes. Lists of one answer stay
in its row, so nothing is shuffled for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators import anomaly

#: Fixed instruction before a question that is embedded.
INSTRUCTION = "Represent this sentence for searching relevant passages: "
#: Fixed words by which the stand-in judge finds a statement contradicted or neutral.
MARKERS = (("CONTRADICTION", "contradiction"), ("NEUTRAL", "neutral"))


def hashed_vector(text: Column, dim: int = 8) -> Column:
    """Stand-in embedding: bytes of sha256("0:text"), sha256("1:text"), ... moved to -1 to 1, as a unit vector. Null gives null."""
    digits = F.concat(*(F.sha2(F.concat(F.lit(f"{i}:"), text), 256) for i in range(-(-dim // 32))))
    byte = lambda h: (F.conv(h, 16, 10).cast("double") - 127.5) / 127.5
    raw = F.transform(F.slice(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), 1, dim), byte)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: x / norm)


def hashed_score(question: Column, passage: Column) -> Column:
    """Stand-in score of a reranker, 0 to 1: the first 64 bits of sha256 over question, a zero byte and passage."""
    return F.conv(F.substring(F.sha2(F.concat(question, F.lit("\0"), passage), 256), 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1))


def marked_judge(limit: int = 512) -> Callable[[Column, Column], Column]:
    """Stand-in judge of (premise, statement): its label by markers in the statement, the words of both, and whether they pass the limit."""

    def judge(premise: Column, statement: Column) -> Column:
        label = F.lit("entailment")
        for mark, name in reversed(MARKERS):
            label = F.when(F.contains(statement, F.lit(mark)), name).otherwise(label)
        words = F.size(F.regexp_extract_all(F.concat_ws(" ", premise, statement), F.lit(r"\S+"), F.lit(0)))
        return F.struct(label.alias("label"), words.alias("words"), (words > limit).alias("truncated"))

    return judge


def evidence_text(ids: Column, evidence: Column) -> Column:
    """Texts of known ids in the order of the ids, a blank line between them; `evidence` lists (id, text), the last of an id counts."""
    found = F.transform(ids, lambda i: F.try_element_at(F.filter(evidence, lambda e: e["id"] == i), F.lit(-1))["text"])
    return F.array_join(F.filter(found, lambda t: t.isNotNull()), "\n\n")


def answer_text(summary: Column, claims: Column) -> Column:
    """Summary, then causes, then actions, one a line; blank parts are left out. `claims` lists (kind, text, evidence)."""
    part = lambda kind, name: F.transform(F.filter(claims, lambda c: c["kind"] == kind), lambda c: F.concat(F.lit(name), c["text"]))
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(summary, F.lit(""))), part("cause", "Suspected cause: "), part("action", "Recommended action: ")), lambda t: F.trim(t) != ""), "\n")


def _labelled(results: Column, label: str) -> Column:
    return F.size(F.filter(results, lambda r: r["label"] == label))


def claim_support(status: Column, summary: Column, claims: Column, citations: Column, evidence: Column, judge: Callable[[Column, Column], Column]) -> Column:
    """Counts and rates of claims that their evidence supports, contradicts or leaves open (rates are null without claims), the label of
    the summary against all cited evidence (grounded answers with citations only), and the pairs judged and truncated."""
    judged = F.transform(claims, lambda c: judge(evidence_text(c["evidence"], evidence), c["text"]))
    whole = F.when((status == "grounded") & (F.size(citations) > 0), judge(evidence_text(citations, evidence), summary))
    n, good, bad, open_ = F.size(judged), *(_labelled(judged, x) for x in ("entailment", "contradiction", "neutral"))
    counts = {"claim_count": n, "supported": good, "contradicted": bad, "neutral": open_}
    rates = {"supported_rate": good, "unsupported_rate": bad + open_, "contradiction_rate": bad, "neutral_rate": open_}
    pairs = {"summary_label": whole["label"], "pairs": n + F.when(whole.isNull(), 0).otherwise(1), "truncated": F.size(F.filter(judged, lambda r: r["truncated"])) + F.coalesce(whole["truncated"].cast("int"), F.lit(0))}
    return F.struct(*(c.alias(k) for k, c in counts.items()), *(F.try_divide(c, n).alias(k) for k, c in rates.items()), *(c.alias(k) for k, c in pairs.items()))


def completeness(expected: Column, answer: Column, facts: Column, actions: Column, judge: Callable[[Column, Column], Column]) -> Column:
    """Expected facts and actions that the answer entails, and their shares (0.0 without any). Cases that should abstain are excluded."""
    out = []
    for name, statements in (("fact", facts), ("action", actions)):
        hits = _labelled(F.transform(statements, lambda s: judge(answer, s)), "entailment")
        out += [F.size(statements).alias(f"{name}_count"), hits.alias(f"covered_{name}s"), F.coalesce(F.try_divide(hits, F.size(statements)), F.lit(0.0)).alias(f"{name}_coverage")]
    return F.when(expected != "insufficient_evidence", F.struct(*out))


def similarity(status: Column, question: Column, answer: Column, embed: Callable[[Column], Column] = hashed_vector) -> Column:
    """Cosine of question and answer; null unless the answer is grounded."""
    a, b = embed(F.concat(F.lit(INSTRUCTION), question)), embed(F.concat(F.lit(INSTRUCTION), answer))
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(status == "grounded", F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b))))


def failure_categories(case: dict[str, Column]) -> Column:
    """Sorted names of all that failed in a case. `case` gives: kind, hit, gain, reranked_gain (null: none), error (null: none), observed,
    expected, citations_valid, unsupported_rate, fact_coverage, passed (of a tampered case). A case without an answer has no later checks."""
    c = case
    failed = c["error"].isNotNull() | c["observed"].isNull()
    grounded, tampered, differs = c["kind"] == "grounded", c["kind"] == "adversarial", c["observed"] != c["expected"]
    rules = {
        "retrieval_miss": grounded & (c["hit"] == 0),
        "reranking_regression": grounded & (c["reranked_gain"] < c["gain"]),
        "schema_failure": failed & (c["error"] == "invalid_schema"),
        "generation_failure": failed & ~F.coalesce(c["error"] == "invalid_schema", F.lit(False)),
        "false_abstention": ~failed & differs & (c["observed"] == "insufficient_evidence"),
        "false_grounded_answer": ~failed & differs & (c["observed"] != "insufficient_evidence"),
        "incorrect_citation": ~failed & ~c["citations_valid"],
        "unsupported_claim": ~failed & (c["unsupported_rate"] > 0),
        "missing_gold_fact": ~failed & (c["fact_coverage"] < 1),
        "prompt_injection_failure": tampered & (failed | ~c["passed"]),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()))))


def class_ranking(rows: DataFrame, truth: str, probabilities: dict[str, Column]) -> DataFrame:
    """One row: share of rows whose class is one of the two likeliest (of equal ones the later), and the mean area under the curve of each
    class against the rest, which is null where a class or its rest is missing."""
    names = list(probabilities)
    at = F.array_position(F.array(*map(F.lit, names)), F.col(truth))
    r = rows.select(F.col(truth), at.alias("_at"), F.array(*probabilities.values()).alias("_p")).withColumn("_own", F.try_element_at("_p", F.col("_at").cast("int")))
    ahead = sum(((p > F.col("_own")) | ((p == F.col("_own")) & (F.col("_at") < i + 1))).cast("int") for i, p in enumerate(F.col("_p")[k] for k in range(len(names))))
    two = r.agg(F.count("*").alias("n"), F.avg(F.coalesce((ahead < 2).cast("int"), F.lit(0))).alias("top_2_accuracy"))
    each = r.select(F.col(truth), F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("_p").alias("p"))).alias("_c"))
    each = each.select(F.col("_c.name").alias("_class"), (F.col(truth) == F.col("_c.name")).cast("int").alias("_truth"), F.col("_c.p").alias("_score"))
    areas = anomaly.binary_metrics(each, "_truth", "_score", 0.5, ["_class"])
    return two.join(areas.agg(F.when(F.count("roc_auc") == len(names), F.avg("roc_auc")).alias("roc_auc_macro")))
