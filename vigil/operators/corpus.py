"""Document chunks, change detection and idempotent merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import stable_id


def chunk_tokens(docs: DataFrame, key: str, text: str, target: int, overlap: int, least: int = 1) -> DataFrame:
    """(key, chunk_index, first_token, token_count, chunk_id, content): windows of `target` blank-separated tokens that share `overlap`; a text
    below `least` tokens has none. The last window ends with the text."""
    t = docs.withColumn("_t", F.filter(F.split(text, r"\s+"), lambda x: x != "")).withColumn("_n", F.size("_t")).where(F.col("_n") >= least)
    step = target - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("_n") - target) / step).cast("int")))
    c = t.select(key, "_t", "_n", F.explode(starts).alias("chunk_index"))
    first = F.col("chunk_index") * step
    piece = F.slice("_t", first + 1, F.least(F.lit(target), F.col("_n") - first))
    content = F.array_join(piece, " ")
    return c.select(key, "chunk_index", first.alias("first_token"), F.size(piece).alias("token_count"), stable_id(F.col(key).cast("string"), F.col("chunk_index").cast("string"), content).alias("chunk_id"), content.alias("content"))


def changes(stored: DataFrame, incoming: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, action): inserted, updated, skipped or removed, comparing checksums."""
    a, b = stored.select(key, F.col(checksum).alias("_a")), incoming.select(key, F.col(checksum).alias("_b"))
    act = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "skipped").otherwise("updated")
    return a.join(b, key, "full").select(key, act.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, and the stored ones whose key they don't have; a null key is a key like others."""
    new = incoming.select(F.col(key).alias("_key"))
    return incoming.unionByName(stored.join(new, F.col(key).eqNullSafe(F.col("_key")), "left_anti").select(incoming.columns))


def duplicates_by(docs: DataFrame, by: str, digest: str) -> DataFrame:
    """(by, documents, distinct_documents, duplicates): surplus rows with the same digest."""
    d = docs.groupBy(by, digest).agg(F.count("*").alias("c"))
    return d.groupBy(by).agg(F.sum("c").alias("documents"), F.count("*").alias("distinct_documents"), F.sum(F.col("c") - 1).alias("duplicates"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


#: Fixed legal transitions of an incident.
TRANSITIONS = {"OPEN": ("INVESTIGATING", "RESOLVED"), "INVESTIGATING": ("MITIGATED", "RESOLVED"), "MITIGATED": ("INVESTIGATING", "RESOLVED"), "RESOLVED": ("INVESTIGATING", "CLOSED"), "CLOSED": ()}


def legal(before, after):
    """Whether an incident may go from one state to another; a first event opens it."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, to in TRANSITIONS.items() for b in to))
    return F.when(before.isNull(), after == "OPEN").otherwise(F.array_contains(pairs, F.concat_ws(">", before, after)))


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Each event with the state before it and whether the step is legal."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("before", F.lag(state).over(w)).withColumn("legal", legal(F.col("before"), F.col(state)))


def claims(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, winner, attempts): the first request of each idempotency key wins, the others replay it."""
    return requests.groupBy(key).agg(F.min(F.struct(*order)).alias("_w"), F.count("*").alias("attempts")).select(key, F.col(f"_w.{order[-1]}").alias("winner"), "attempts")


def fold_states(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, events, state, applied): an incident's state after its events in order; illegal steps change nothing. One incident's events, which are few, are folded together."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, to in TRANSITIONS.items() for b in to))
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(state).alias("_s")))), lambda x: x["_s"])
    start = F.struct(F.lit("OPEN").alias("s"), F.lit(0).alias("n"))
    move = lambda acc, x: F.when(F.array_contains(pairs, F.concat_ws(">", acc["s"], x)), F.struct(x.alias("s"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    g = events.groupBy(key).agg(steps.alias("_t")).select(key, F.size("_t").cast("long").alias("events"), F.aggregate("_t", start, move).alias("_f"))
    return g.select(key, "events", F.col("_f.s").alias("state"), F.col("_f.n").cast("long").alias("applied"))
