"""Tables whose rows carry versions: one-pass ingestion, writes that name the version they expect, and registries with aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ingest(stored: DataFrame, incoming: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, checksum, active, version, action): the table after a batch that holds all current rows, with what happened to each.

    stored has key, checksum, active and version, each key once. A new row is inserted with version 1; another checksum makes an update, which also makes the row active
    again; the same checksum of an inactive row reactivates it, of an active one is skipped. Active rows that don't come are removed: kept, but inactive. Inactive ones
    that don't come are absent. Each change adds 1 to the version, so a batch that comes again changes nothing. A null key is a key like others, a null
    checksum equals a null one. A key that comes more than once counts by its largest checksum, so reruns agree. One join on the key, and one pass."""
    new = incoming.groupBy(F.col(key).alias("_key")).agg(F.max(checksum).alias("_new"), F.lit(True).alias("_came"))
    old = stored.select(F.col(key).alias("_old_key"), F.col(checksum).alias("_old"), F.col("active").alias("_active"), F.col("version").cast("long").alias("_version"))
    both = old.join(new, F.col("_old_key").eqNullSafe(F.col("_key")), "full")
    was, came, active = F.col("_version").isNotNull(), F.coalesce("_came", F.lit(False)), F.coalesce("_active", F.lit(False))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    action = F.when(~was, "inserted").when(came & ~same, "updated").when(came & ~active, "reactivated").when(came, "skipped").when(active, "removed").otherwise("absent")
    changed = action.isin("inserted", "updated", "reactivated", "removed").cast("long")
    return both.select(
        F.when(was, F.col("_old_key")).otherwise(F.col("_key")).alias(key), F.when(came, F.col("_new")).otherwise(F.col("_old")).alias(checksum), came.alias("active"),
        (F.coalesce("_version", F.lit(0)) + changed).alias("version"), action.alias("action"),
    )


def ingest_counts(done: DataFrame) -> DataFrame:
    """One row with the number of rows of each action; zeros for an empty table."""
    return done.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "skipped", "reactivated", "removed", "absent")))


def compare_and_set(writes: DataFrame, key: str, order: list[str], expected: str) -> DataFrame:
    """Each write with its outcome and the version that it left: a write is applied if it expects the version that the row has just then.

    Rows begin with version 0; a null expectation asks for nothing and is always applied; an applied write adds 1, another is a conflict that changes nothing. order is total
    within a key; ties are broken by the expectation. The writes of one key, which are few, are folded together, as one row's writes depend on each other; a null key is one key."""
    seen = F.array_sort(F.collect_list(F.struct(*order, F.col(expected).cast("long").alias("_expected"))))
    start = F.struct(F.lit(0).cast("long").alias("version"), F.array().cast("array<struct<outcome:string,version:bigint>>").alias("out"))

    def step(state: Column, write: Column) -> Column:
        ok = write["_expected"].isNull() | (write["_expected"] == state["version"])
        now = state["version"] + ok.cast("long")
        return F.struct(now.alias("version"), F.array_append(state["out"], F.struct(F.when(ok, "APPLIED").otherwise("CONFLICT").alias("outcome"), now.alias("version"))).alias("out"))

    g = writes.groupBy(key).agg(seen.alias("_w"))
    e = g.select(key, F.explode(F.arrays_zip("_w", F.aggregate("_w", start, step)["out"].alias("_o"))).alias("_x"))
    return e.select(key, *(F.col(f"_x._w.{o}").alias(o) for o in order), F.col("_x._w._expected").alias(expected), F.col("_x._o.outcome").alias("outcome"), F.col("_x._o.version").alias("version"))


def registrations(requests: DataFrame, model: str, source: str, digest: str, order: list[str]) -> DataFrame:
    """Each request to register with its outcome and version: the first of a source is registered, the same digest again reuses that version, another one is a mismatch.

    Versions number a model's sources from 1 by their first request in a total order. Sources are found by aggregation first, so only one row of each is numbered; a model's
    sources are sorted together, which spills. Null models, sources and digests are values like others."""
    names = [model, source]
    first = requests.groupBy(*names).agg(F.min(F.struct(*order, F.col(digest).alias("_digest"))).alias("_first"))
    numbered = first.withColumn("version", F.row_number().over(Window.partitionBy(model).orderBy("_first", source)).cast("long"))
    a, b = requests.alias("a"), numbered.alias("b")
    on = F.col(f"a.{model}").eqNullSafe(F.col(f"b.{model}")) & F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}"))
    is_first = F.struct(*(F.col(f"a.{o}").alias(o) for o in order)) == F.struct(*(F.col(f"b._first.{o}").alias(o) for o in order))
    same = F.col(f"a.{digest}").eqNullSafe(F.col("b._first._digest"))
    outcome = F.when(same & is_first, "REGISTERED").when(same, "REUSED").otherwise("MISMATCH")
    return a.join(b, on).select("a.*", outcome.alias("outcome"), F.when(same, F.col("b.version")).alias("version"))


def alias_audit(moves: DataFrame, versions: DataFrame, model: str, order: list[str]) -> DataFrame:
    """The log's moves (model, order, action, version) with status and the champion before: a move to a version that isn't there, or isn't valid, is rejected.

    versions has model, version and valid, each once. candidate, promote and rollback are actions; a promotion or rollback of the champion itself is
    applied and changes nothing. A model's moves are sorted in one window with a running value, which spills and holds no list."""
    v = versions.select(F.col(model).alias("_m"), F.col("version").alias("_v"), "valid")
    m = moves.join(v, (F.col(model) == F.col("_m")) & (F.col("version") == F.col("_v")), "left").drop("_m", "_v")
    status = F.when(F.col("valid").isNull(), "UNKNOWN_VERSION").when(~F.col("valid"), "NOT_VALID").when(F.col("action").isin("candidate", "promote", "rollback"), "APPLIED").otherwise("UNKNOWN_ACTION")
    m = m.withColumn("status", status).drop("valid")
    before = Window.partitionBy(model).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    led = F.when((F.col("status") == "APPLIED") & F.col("action").isin("promote", "rollback"), F.col("version"))
    return m.withColumn("champion_before", F.last(led, ignorenulls=True).over(before))


def aliases(audit: DataFrame, model: str, order: list[str]) -> DataFrame:
    """(model, candidate, champion, previous_champion, applied, rejected): where a model's aliases stand after its log.

    The previous champion is the last applied one that isn't the champion; so two aggregations find it, combined before they are shuffled, and no fold of a log
    is needed. A model without applied moves has no aliases; a null model is a model like others."""
    ok, leads = F.col("status") == "APPLIED", F.col("action").isin("promote", "rollback")
    at = F.struct(*order)
    by = audit.groupBy(model, "version").agg(F.max(F.when(ok & leads, at)).alias("_led"), F.max(F.when(ok & (F.col("action") == "candidate"), at)).alias("_stood"), F.count_if(ok).alias("_ok"), F.count_if(~ok).alias("_no"))
    led = F.when(F.col("_led").isNotNull(), F.struct(F.col("_led").alias("at"), F.col("version")))
    # of each version only its last leading move is left, so the two latest of a model are the champion and the one before
    g = by.groupBy(model).agg(F.max_by("version", "_stood").alias("candidate"), F.max(led).alias("_champion"), F.sum("_ok").alias("applied"), F.sum("_no").alias("rejected"))
    c = g.select(F.col(model).alias("_m"), F.col("_champion.version").alias("_c"))
    earlier = by.where("_led IS NOT NULL").join(c, F.col(model).eqNullSafe(F.col("_m")) & (F.col("version") != F.col("_c"))).groupBy(F.col("_m").alias("_p")).agg(F.max_by("version", "_led").alias("previous_champion"))
    return g.join(earlier, F.col(model).eqNullSafe(F.col("_p")), "left").select(model, "candidate", F.col("_champion.version").alias("champion"), "previous_champion", "applied", "rejected")
