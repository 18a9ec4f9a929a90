"""Queries over versioned tables and registries, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import versions
from vigil.plans.catalog import query
from vigil.sources.tables import table

_INGEST_SQL = """o AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN trim(text) || '.' ELSE coalesce(text, '') END) AS checksum, n_chars % 3 <> 0 AS active, n_chars % 5 + 1 AS version FROM documents WHERE n_chars % 7 <> 1),
n AS (SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents WHERE n_chars % 11 <> 4),
a AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.checksum, o.checksum) AS checksum, n.doc_id IS NOT NULL AS active, coalesce(version, 0) AS v,
 CASE WHEN o.doc_id IS NULL THEN 'inserted' WHEN n.doc_id IS NOT NULL AND n.checksum <> o.checksum THEN 'updated' WHEN n.doc_id IS NOT NULL AND NOT o.active THEN 'reactivated' WHEN n.doc_id IS NOT NULL THEN 'skipped' WHEN o.active THEN 'removed' ELSE 'absent' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id)"""


def _ingested(spark, d):
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    old = docs.where("n_chars % 7 <> 1").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat(F.trim("text"), F.lit("."))).otherwise(text), 256).alias("checksum"), (F.col("n_chars") % 3 != 0).alias("active"), (F.col("n_chars") % 5 + 1).alias("version"))
    return versions.ingest(old, docs.where("n_chars % 11 <> 4").select("doc_id", F.sha2(text, 256).alias("checksum")), "doc_id", "checksum")


@query(f"WITH {_INGEST_SQL} SELECT doc_id, checksum, active, v + (action NOT IN ('skipped', 'absent'))::INT AS version, action FROM a")
def ingest_table(spark, d):
    """Documents after a batch: an earlier state of them, made by their length and language, meets the current one."""
    return _ingested(spark, d)


@query(f"WITH {_INGEST_SQL} SELECT {', '.join(f'count(*) FILTER (action = {a!r}) AS {a}' for a in ('inserted', 'updated', 'skipped', 'reactivated', 'removed', 'absent'))} FROM a")
def ingest_counts(spark, d):
    """What a batch changes, counted."""
    return versions.ingest_counts(_ingested(spark, d))


@query("""WITH RECURSIVE w AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_quantity <= 45 THEN (l_partkey % 3)::BIGINT END AS expected, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, CASE WHEN l_quantity <= 45 THEN l_partkey % 3 END NULLS FIRST) AS i FROM lineitem),
f AS (SELECT l_orderkey, 0::BIGINT AS i, NULL::INT AS l_linenumber, NULL::BIGINT AS l_suppkey, NULL::BIGINT AS expected, NULL::VARCHAR AS outcome, 0::BIGINT AS version FROM w GROUP BY l_orderkey
 UNION ALL SELECT w.l_orderkey, w.i, w.l_linenumber, w.l_suppkey, w.expected, CASE WHEN w.expected IS NULL OR w.expected = f.version THEN 'APPLIED' ELSE 'CONFLICT' END, f.version + (w.expected IS NULL OR w.expected = f.version)::INT FROM f JOIN w ON w.l_orderkey = f.l_orderkey AND w.i = f.i + 1)
SELECT l_orderkey, l_linenumber, l_suppkey, expected, outcome, version FROM f WHERE i > 0""")
def versioned_writes(spark, d):
    """Writes to orders that expect a version; lines stand for writes, those of much quantity expect none."""
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_quantity") <= 45, F.col("l_partkey") % 3).alias("expected"))
    return versions.compare_and_set(w, "l_orderkey", ["l_linenumber", "l_suppkey"], "expected")


@query("""WITH r AS (SELECT event_id, user_id AS model, event_type || (floor(value)::BIGINT % 3) AS source, (props::JSON->>'k')::INT % 2 AS digest FROM events),
s AS (SELECT model, source, min(event_id) AS first, arg_min(digest, event_id) AS digest FROM r GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY first) AS version FROM s)
SELECT event_id, r.model, r.source, r.digest, CASE WHEN r.digest <> n.digest THEN 'MISMATCH' WHEN event_id = first THEN 'REGISTERED' ELSE 'REUSED' END AS outcome, CASE WHEN r.digest = n.digest THEN version END AS version FROM r JOIN n ON r.model = n.model AND r.source = n.source""")
def model_registrations(spark, d):
    """Imports into a registry: a user's events are requests of one model's sources, with a digest from their properties."""
    e = table(spark, d, "events")
    r = e.select("event_id", F.col("user_id").alias("model"), F.concat("event_type", (F.floor("value") % 3).cast("string")).alias("source"), (F.get_json_object("props", "$.k").cast("int") % 2).alias("digest"))
    return versions.registrations(r, "model", "source", "digest", ["event_id"])


_MOVES_SQL = """v AS (SELECT user_id AS model, floor(value)::BIGINT % 6 AS version, bool_or(event_type <> 'error') AS valid FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
m AS (SELECT e.user_id AS model, event_id, CASE WHEN event_type = 'signup' THEN 'candidate' WHEN event_type = 'error' THEN 'rollback' ELSE 'promote' END AS action, floor(value)::BIGINT % 6 AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events e),
s AS (SELECT m.*, CASE WHEN valid IS NULL THEN 'UNKNOWN_VERSION' WHEN NOT valid THEN 'NOT_VALID' ELSE 'APPLIED' END AS status FROM m LEFT JOIN v ON v.model = m.model AND v.version = m.version),
f AS (SELECT model, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::BIGINT AS version, NULL::VARCHAR AS status, NULL::BIGINT AS champion_before, NULL::BIGINT AS champion, NULL::BIGINT AS previous, NULL::BIGINT AS candidate, 0 AS applied FROM s GROUP BY model
 UNION ALL SELECT s.model, s.i, s.event_id, s.action, s.version, s.status, f.champion, CASE WHEN s.status = 'APPLIED' AND s.action <> 'candidate' THEN s.version ELSE f.champion END,
  CASE WHEN s.status = 'APPLIED' AND s.action <> 'candidate' AND f.champion <> s.version THEN f.champion ELSE f.previous END, CASE WHEN s.status = 'APPLIED' AND s.action = 'candidate' THEN s.version ELSE f.candidate END, f.applied + (s.status = 'APPLIED')::INT
 FROM f JOIN s ON s.model = f.model AND s.i = f.i + 1)"""


def _audit(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("model"), "event_id", "event_type", (F.floor("value") % 6).alias("version"))
    known = e.where("event_type <> 'view'").groupBy("model", "version").agg(F.bool_or(F.col("event_type") != "error").alias("valid"))
    moves = e.select("model", "event_id", F.when(F.col("event_type") == "signup", "candidate").when(F.col("event_type") == "error", "rollback").otherwise("promote").alias("action"), "version")
    return versions.alias_audit(moves, known, "model", ["event_id"])


@query(f"WITH RECURSIVE {_MOVES_SQL} SELECT model, event_id, action, version, status, champion_before FROM f WHERE i > 0")
def alias_audit(spark, d):
    """The log of alias moves of each model with status and the champion before; equal to a recursive fold."""
    return _audit(spark, d)


@query(f"WITH RECURSIVE {_MOVES_SQL} SELECT model, arg_max(struct_pack(x := candidate), i).x AS candidate, arg_max(struct_pack(x := champion), i).x AS champion, arg_max(struct_pack(x := previous), i).x AS previous_champion, max(applied)::BIGINT AS applied, (max(i) - max(applied))::BIGINT AS rejected FROM f GROUP BY model")
def alias_state(spark, d):
    """Candidate, champion and previous champion of each model after its log."""
    return versions.aliases(_audit(spark, d), "model", ["event_id"])
