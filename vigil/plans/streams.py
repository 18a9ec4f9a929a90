"""Queries over streams, and the same as DuckDB SQL over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.incidents import ROOTS
from vigil.plans.catalog import STATES, query
from vigil.plans.operations import _LEGAL
from vigil.sources.tables import folder, table
from vigil.streaming import ledger, lifecycle

_COMMANDS_SQL = f"""c AS (SELECT user_id AS incident, event_id AS seq, epoch_us(ts) AS at_us, event_type AS e, (props::JSON->>'k')::INT AS k, floor(value)::BIGINT AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
commands AS (SELECT incident, at_us, seq, CASE e WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'TRANSITION' WHEN 'purchase' THEN 'NOTE' ELSE 'UPDATE' END AS command,
 CASE WHEN e = 'click' THEN {list(STATES)}[(v % 5 + 1)::INT] END AS target, CASE WHEN e = 'click' AND k % 4 = 0 THEN v % 6 END AS expected, e = 'signup' OR (e = 'view' AND k % 3 <> 0) AS has_owner,
 CASE WHEN e = 'signup' OR (e = 'view' AND k % 3 = 2) THEN 'owner ' || k END AS owner, e = 'view' AND k % 4 <> 3 AS has_cause, CASE WHEN e = 'view' AND k % 4 IN (1, 2) THEN 'cause ' || (k % 2) END AS cause, e = 'error' AS has_fix, CASE WHEN e = 'error' THEN 'fix ' || (v % 3) END AS fix,
 row_number() OVER (PARTITION BY incident ORDER BY at_us, seq) AS i FROM c)"""


def commands(spark, d) -> DataFrame:
    """Events as commands to an incident for each user: what a row asks for follows from its type, value and properties."""
    k, v, e = F.get_json_object("props", "$.k").cast("int"), F.floor("value"), F.col("event_type")
    n = F.lit(None).cast("string")
    t = table(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    return t.select(
        F.col("user_id").alias("incident"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("seq"),
        F.when(e == "signup", "CREATE").when(e == "click", "TRANSITION").when(e == "purchase", "NOTE").otherwise("UPDATE").alias("command"),
        F.when(e == "click", F.element_at(F.array(*map(F.lit, STATES)), (v % 5 + 1).cast("int"))).alias("target"), F.when((e == "click") & (k % 4 == 0), v % 6).alias("expected"), n.alias("title"), n.alias("description"), n.alias("severity"),
        F.when((e == "signup") | (e == "view") & (k % 3 == 2), F.concat(F.lit(" owner "), k.cast("string"))).when((e == "view") & (k % 3 == 1), "  ").alias("owner"), n.alias("services"),
        F.when((e == "view") & k.isin(*range(0, 100, 4)) | (e == "view") & k.isNull(), " ").when((e == "view") & (k % 4 != 3), F.concat(F.lit("cause "), (k % 2).cast("string"))).alias("root_cause"),
        F.when(e == "error", F.concat(F.lit("fix "), (v % 3).cast("string"))).alias("remediation"),
    )


def run_slices(rows: DataFrame, at: str, place: str, bounds: tuple[int, int], slices: int, far: DataFrame, made: Callable[[DataFrame], DataFrame], outcomes: str, checkpoint: str) -> DataFrame:
    """A table as files for a stream, by time; with the last come those that move the watermark beyond everything. Equal slices of time, not of rows. Each slice is taken up by a
    run of its own once all its files are there, so it is one batch however many they are, and none of it can come after a watermark of later files. What `made` makes of the stream, as a table."""
    spark, (low, high) = rows.sparkSession, bounds
    width, empty_batches = (high - low) // slices + 1, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty_batches)
    try:
        for i in range(slices):
            rows.where(F.floor((F.col(at) - low) / width) == i).write.mode("append").parquet(place)
            if i == slices - 1:
                far.coalesce(1).write.mode("append").parquet(place)
            spark.conf.set(empty_batches, str(i == slices - 1).lower())  # what a slice makes due is done with the next one
            out = made(spark.readStream.schema(rows.schema).parquet(place))
            run_available(out, outcomes, checkpoint)
    finally:
        spark.conf.set(empty_batches, before)
    return spark.read.schema(out.schema).parquet(outcomes)


def run_available(out: DataFrame, place: str, checkpoint: str, mode: str = "append") -> None:
    q = out.writeStream.outputMode(mode).format("parquet").option("path", place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@query(f"""WITH RECURSIVE {_COMMANDS_SQL},
f AS (SELECT incident, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS entries, NULL::VARCHAR AS message, NULL::VARCHAR AS status, NULL::BIGINT AS version, NULL::BIGINT AS resolved_us, NULL::BIGINT AS closed_us, NULL::VARCHAR AS owner, NULL::VARCHAR AS root_cause, NULL::VARCHAR AS remediation FROM commands GROUP BY incident
 UNION ALL SELECT incident, i, seq, outcome, CASE WHEN outcome <> 'APPLIED' THEN '' WHEN command = 'CREATE' THEN 'INCIDENT_CREATED' WHEN command = 'TRANSITION' THEN 'STATUS_CHANGED' WHEN command = 'NOTE' THEN 'NOTE_ADDED' ELSE
   concat_ws(',', CASE WHEN has_owner THEN 'DETAILS_UPDATED' END, CASE WHEN has_cause AND cause IS DISTINCT FROM root_cause THEN 'ROOT_CAUSE_UPDATED' END, CASE WHEN has_fix AND fix IS DISTINCT FROM remediation THEN 'REMEDIATION_UPDATED' END) END,
  CASE WHEN outcome = 'APPLIED' AND command = 'TRANSITION' THEN status || ' -> ' || target END,
  CASE WHEN outcome <> 'APPLIED' THEN status WHEN command = 'CREATE' THEN 'OPEN' WHEN command = 'TRANSITION' THEN target ELSE status END,
  CASE WHEN outcome <> 'APPLIED' THEN version WHEN command = 'CREATE' THEN 0 WHEN command = 'NOTE' THEN version ELSE version + 1 END,
  CASE WHEN outcome <> 'APPLIED' OR command <> 'TRANSITION' THEN resolved_us WHEN target = 'RESOLVED' THEN at_us WHEN status = 'RESOLVED' AND target = 'INVESTIGATING' THEN NULL ELSE resolved_us END,
  CASE WHEN outcome = 'APPLIED' AND command = 'TRANSITION' AND target = 'CLOSED' THEN at_us ELSE closed_us END,
  CASE WHEN outcome = 'APPLIED' AND command IN ('CREATE', 'UPDATE') AND has_owner THEN new_owner ELSE owner END, CASE WHEN outcome = 'APPLIED' AND command = 'UPDATE' AND has_cause THEN cause ELSE root_cause END, CASE WHEN outcome = 'APPLIED' AND command = 'UPDATE' AND has_fix THEN fix ELSE remediation END
 FROM (SELECT f.incident, c.i, c.seq, c.at_us, c.command, c.target, c.has_owner, c.owner AS new_owner, c.has_cause, c.cause, c.has_fix, c.fix, f.status, f.version, f.resolved_us, f.closed_us, f.owner, f.root_cause, f.remediation,
   CASE WHEN c.command = 'CREATE' THEN CASE WHEN f.status IS NULL THEN 'APPLIED' ELSE 'ALREADY_EXISTS' END WHEN f.status IS NULL THEN 'UNKNOWN_INCIDENT' WHEN c.expected IS NOT NULL AND c.expected <> f.version THEN 'STALE_VERSION'
    WHEN c.command = 'TRANSITION' AND f.status || '>' || c.target NOT IN {_LEGAL} THEN 'ILLEGAL_TRANSITION' ELSE 'APPLIED' END AS outcome FROM f JOIN commands c ON c.incident = f.incident AND c.i = f.i + 1))
SELECT incident, seq, outcome, entries, message, status, version, resolved_us, closed_us, owner, root_cause, remediation FROM f WHERE i > 0""")
def incident_stream(spark, d):
    """Incidents as keyed state of a file stream of four slices and a last row that moves the watermark beyond them; the same as a recursive fold of the whole table."""
    lifecycle.with_keyed_state(spark)
    made, at = commands(spark, d), folder(spark, "incidents")
    low, high, n = made.agg(F.coalesce(F.min("at_us"), F.lit(0)), F.coalesce(F.max("at_us"), F.lit(0)), F.count("*")).first()
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in made.dtypes if c not in ("incident", "at_us")]
    far = spark.range(1).select(F.lit(None).cast("long").alias("incident"), F.lit(high + 2 * 3_600_000_000).alias("at_us"), *nothing).select(*made.columns)
    live = lambda stream: lifecycle.lifecycle_stream(stream, "incident", "1 hour", groups=max(64, n // 4096))
    out = run_slices(made, "at_us", f"{at}/commands", (low, high), 4, far, live, f"{at}/outcomes", f"{at}/state")
    return out.select("incident", "seq", "outcome", "entries", "message", "status", "version", "resolved_us", "closed_us", "owner", "root_cause", "remediation")


_RAW_SQL = """raw AS (SELECT event_id AS o, props, (props::JSON->>'k')::INT AS k, floor(value)::BIGINT AS v, 'svc-' || (user_id % 10) AS svc, ['metrics','logs','traces','profiles','metrics'][list_position(['click','view','error','signup','purchase'], event_type)] AS s FROM events WHERE event_type IS NOT NULL),
shaped AS (SELECT *, CASE s WHEN 'metrics' THEN 'resourceMetrics' WHEN 'logs' THEN 'resourceLogs' ELSE 'resourceSpans' END AS root, k % 10 = 9 AS headless FROM raw),
judged AS (SELECT *, CASE WHEN v % 7 = 3 THEN '{"' || root || '": [' WHEN v % 7 = 5 THEN '{"' || root || '": {}}' WHEN v % 7 = 6 THEN props ELSE '{"' || root || '":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"' || svc || '"}}]}}]}' END AS body,
 CASE WHEN headless THEN 'missing_header' WHEN s = 'profiles' THEN 'unsupported_signal' WHEN v % 7 = 3 THEN 'invalid_json' WHEN v % 7 = 5 THEN 'invalid_structure' END AS error FROM shaped)"""


def raw_records(spark, d) -> DataFrame:
    """Events as raw records of one topic partition; type, value and properties decide signal, headers and body."""
    k, v = F.get_json_object("props", "$.k").cast("int"), F.floor("value")
    signals = F.create_map(*(F.lit(x) for kv in {"click": "metrics", "view": "logs", "error": "traces", "signup": "profiles", "purchase": "metrics"}.items() for x in kv))
    s = F.element_at(signals, F.col("event_type"))
    root = F.when(s == "metrics", "resourceMetrics").when(s == "logs", "resourceLogs").otherwise("resourceSpans")
    whole = F.concat(F.lit('{"'), root, F.lit('":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'), (F.col("user_id") % 10).cast("string"), F.lit('"}}]}}]}'))
    body = F.when(v % 7 == 3, F.concat(F.lit('{"'), root, F.lit('": ['))).when(v % 7 == 5, F.concat(F.lit('{"'), root, F.lit('": {}}'))).when(v % 7 == 6, F.col("props")).otherwise(whole)
    headers = F.create_map(F.lit("event_type"), F.when(k % 10 == 9, "").otherwise("telemetry.raw"), F.lit("schema_version"), F.lit("1"), F.lit("signal"), s)
    t = table(spark, d, "events").where("event_type IS NOT NULL")
    return t.select(F.lit("raw").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), headers.alias("headers"), body.cast("binary").alias("value"))


@query(f"""WITH {_RAW_SQL} SELECT sha256('raw:0:' || o) AS event_id, s AS signal, CASE WHEN error IS NULL THEN 'good' ELSE 'dead' END AS sink, error, CASE WHEN error IS NULL AND v % 7 <> 6 THEN svc ELSE sha256('raw:0:' || o) END AS key, CASE WHEN error IS NOT NULL THEN base64(body::BLOB) END AS payload_base64 FROM judged""")
def routed_stream(spark, d):
    """Raw records as a file stream in micro-batches, each judged once and written to two sinks under a ledger; what both sinks hold of whole batches."""
    raw, at = raw_records(spark, d), folder(spark, "routed")
    raw.repartitionByRange(4, "offset").write.parquet(f"{at}/raw")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/raw")
    q = stream.writeStream.foreachBatch(ledger.Router(at)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    own = "event_id string, signal string, key string"
    good = ledger.delivered(spark, at, "good", own).select("event_id", "signal", F.lit("good").alias("sink"), F.lit(None).cast("string").alias("error"), "key", F.lit(None).cast("string").alias("payload_base64"))
    return good.unionByName(ledger.delivered(spark, at, "dead", own + ", error string, payload_base64 string").select("event_id", "signal", F.lit("dead").alias("sink"), "error", "key", "payload_base64"))


@query("""WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'metrics' WHEN 'view' THEN 'logs' ELSE 'traces' END AS s, event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'error')),
r AS (SELECT *, row_number() OVER (ORDER BY list_position(['metrics','logs','traces'], s), event_id) AS i FROM c)
SELECT i - 1 AS "offset", 'run-1' AS key, s AS signal, '{"' || CASE s WHEN 'metrics' THEN 'resourceMetrics' WHEN 'logs' THEN 'resourceLogs' ELSE 'resourceSpans' END || '":[],"line":' || event_id || '}' AS line FROM r WHERE i <= (SELECT count(*) * 4 // 5 FROM c)""")
def capture_replay(spark, d):
    """Events as lines of a capture of three signals, replayed up to four fifths of their number, in the order of signals and lines."""
    signal = F.create_map(*map(F.lit, ("click", "metrics", "view", "logs", "error", "traces")))[F.col("event_type")]
    root = F.create_map(*(F.lit(x) for kv in ROOTS.items() for x in kv))
    e = table(spark, d, "events").where("event_type IN ('click', 'view', 'error')").select(signal.alias("signal"), F.col("event_id").alias("line_number"))
    lines = e.withColumn("value", F.concat(F.lit('{"'), root[F.col("signal")], F.lit('":[],"line":'), F.col("line_number").cast("string"), F.lit("}")).cast("binary"))
    out = ledger.replay(lines, "run-1", "scenario", "label", limit=lines.count() * 4 // 5)
    return out.select("offset", "key", F.col("headers")["signal"].alias("signal"), F.col("value").cast("string").alias("line"))
