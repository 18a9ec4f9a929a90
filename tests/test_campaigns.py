"""Edge cases of the checks of captures, plans and datasets, and of judged answers."""

from pyspark.sql import functions as F

from vigil.operators import campaigns, evaluation


def test_line_with_two_services_counts_once(spark):
    root = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"b"}}]}},{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"a"}}]}},{"resource":{}}]}'
    rows = [("r", "logs", root), ("r", "logs", root), ("r", "logs", "  "), ("r", "logs", '{"resourceLogs":1}'), ("r", "logs", "{"), ("r", "logs", '{"resourceLogs":[]}')]
    (r,) = campaigns.capture_counts(spark.createDataFrame(rows, "run_id string, signal string, line string")).collect()
    assert (r.batches, r.broken, r.services) == (5, 2, ["a", "b"])


def test_manifest_of_null_and_empty_text(spark):
    r = spark.createDataFrame([(None,), ("",), ("[1]",)], "t string").select(campaigns.manifest_error(F.col("t"), F.lit("r"), ["normal"]).alias("e")).collect()
    assert [x.e for x in r] == ["invalid_json", "invalid_json", "missing_fields"]


def test_digest_ignores_order_and_sees_repeats(spark):
    make = lambda rows: campaigns.digest(spark.createDataFrame(rows, "a long, b string")).first().digest
    assert make([(1, "x"), (2, None)]) == make([(2, None), (1, "x")])
    assert len({make([(1, "x")]), make([(1, "x"), (1, "x")]), make([(1, None)]), make([(1, "")]), make([])}) == 5


def test_failed_run_keeps_its_code_until_a_success(spark):
    rows = [(1, 1, "RUNNING", None), (1, 2, "FAILED", "E"), (1, 3, "RUNNING", None), (2, 1, "FAILED", "E"), (2, 2, "GROUNDED_ADVISORY", None)]
    r = {x.k: x for x in campaigns.run_states(spark.createDataFrame(rows, "k int, i int, s string, c string"), "k", ["i"], "s", "c").collect()}
    assert (r[1].status, r[1].completed_at, r[1].failure_code, r[1].entries) == ("RUNNING", 2, "E", 3)
    assert (r[2].status, r[2].completed_at, r[2].failure_code) == ("GROUNDED_ADVISORY", 2, None)


def test_support_without_claims_and_with_unknown_evidence(spark):
    none = F.array().cast("array<struct<kind: string, text: string, evidence: array<string>>>")
    one = F.array(F.struct(F.lit("cause").alias("kind"), F.lit("x NEUTRAL").alias("text"), F.array(F.lit("E9"), F.lit("E1")).alias("evidence")))
    evidence = F.array(F.struct(F.lit("E1").alias("id"), F.lit("a b").alias("text")))
    judge = evaluation.marked_judge(3)
    r = spark.range(1).select(*(evaluation.claim_support(F.lit("grounded"), F.lit("s"), c, F.array().cast("array<string>"), evidence, judge).alias(n) for n, c in (("a", none), ("b", one)))).first()
    assert (r.a.claim_count, r.a.supported_rate, r.a.summary_label, r.a.pairs) == (0, None, None, 0)
    assert (r.b.neutral, r.b.unsupported_rate, r.b.truncated) == (1, 1.0, 1)
