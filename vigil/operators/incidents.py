"""Incidents and raw records as tables of events: effects of transitions, partial updates, claims; records as processed events or dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.corpus import TRANSITIONS


def fold_effects(events: DataFrame, key: str, order: list[str], state: str, at: str) -> DataFrame:
    """(key, state, resolved_at, closed_at, applied): an incident after its events. An illegal step changes nothing; a resolution is dated,
    reopening clears that date, closing is dated for good. One incident's events, which are few, are folded together."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, to in TRANSITIONS.items() for b in to))
    kind = dict(events.dtypes)[at]
    none = F.lit(None).cast(kind)
    start = F.struct(F.lit("OPEN").alias("s"), none.alias("r"), none.alias("c"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        resolved = F.when(x["_s"] == "RESOLVED", x["_t"]).when((a["s"] == "RESOLVED") & (x["_s"] == "INVESTIGATING"), none).otherwise(a["r"])
        after = F.struct(x["_s"].alias("s"), resolved.alias("r"), F.when(x["_s"] == "CLOSED", x["_t"]).otherwise(a["c"]).alias("c"), (a["n"] + 1).alias("n"))
        return F.when(F.array_contains(pairs, F.concat_ws(">", a["s"], x["_s"])), after).otherwise(a)

    steps = F.array_sort(F.collect_list(F.struct(*order, F.col(state).alias("_s"), F.col(at).alias("_t"))))
    f = events.groupBy(key).agg(steps.alias("_e")).select(key, F.aggregate("_e", start, step).alias("_f"))
    return f.select(key, F.col("_f.s").alias("state"), F.col("_f.r").alias("resolved_at"), F.col("_f.c").alias("closed_at"), F.col("_f.n").alias("applied"))


def latest_fields(updates: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, fields, changes): each field's last value that isn't missing, a blank one clearing it; and how many updates set something."""
    last = [F.max_by(F.when(F.col(f).isNotNull(), F.trim(f)), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields]
    some = F.lit(False)
    for f in fields:
        some = some | F.col(f).isNotNull()
    g = updates.groupBy(key).agg(*last, F.count_if(some).alias("changes"))
    return g.select(key, *(F.nullif(F.col(f), F.lit("")).alias(f) for f in fields), "changes")


def services_of(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, services): names trimmed and in lower case, each once, in order, comma-joined; blank ones don't count."""
    n = F.lower(F.trim(name))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.when(n != "", n))), ",").alias("services"))


#: Fixed headers that a raw record must have, and the values of two of them.
REQUIRED = ("event_type", "schema_version", "signal")
ROOTS = {"metrics": "resourceMetrics", "logs": "resourceLogs", "traces": "resourceSpans"}


def processed(raw: DataFrame) -> DataFrame:
    """From (topic, partition, offset, headers map, value binary): event_id, signal, error, services, routing key, and of dead letters
    the value as unbroken base64. The first broken rule names the error: headers, signal, encoding, JSON, object, root array. Identities depend
    on the place in the topic alone, so replays repeat them."""
    h = lambda k: F.try_element_at("headers", F.lit(k))
    text = F.col("value").cast("string")
    doc = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    kind = F.schema_of_variant(F.variant_get(doc, "$.v", "variant"))
    at_root = F.coalesce(*(F.when(h("signal") == s, F.get_json_object(text, f"$.{root}")) for s, root in ROOTS.items()))
    missing = F.lit(False)
    for k in REQUIRED:
        missing = missing | (F.coalesce(h(k), F.lit("")) == "")
    error = (
        F.when(missing | (h("event_type") != "telemetry.raw") | (h("schema_version") != "1"), "missing_header").when(~h("signal").isin(*ROOTS), "unsupported_signal").when(F.col("value").isNull() | ~F.is_valid_utf8(text), "invalid_utf8")
        .when(doc.isNull() | listed.isNull(), "invalid_json").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)) | (at_root.isNotNull() & ~F.trim(at_root).startswith("[")), "invalid_structure")
    )
    out = raw.withColumn("event_id", F.sha2(F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")), 256)).withColumn("signal", h("signal")).withColumn("error", error)
    resource = "array<struct<resource: struct<attributes: array<struct<key: string, value: struct<stringValue: string>>>>>>"
    names = F.transform(F.filter(F.flatten(F.transform(F.from_json(at_root, resource), lambda r: r["resource"]["attributes"])), lambda a: a["key"] == "service.name"), lambda a: a["value"]["stringValue"])
    names = F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))), F.expr("cast(array() as array<string>)"))
    out = out.withColumn("services", F.when(F.col("error").isNull(), names)).withColumn("key", F.coalesce(F.try_element_at("services", F.lit(1)), F.col("event_id")))
    return out.withColumn("payload_base64", F.when(F.col("error").isNotNull(), F.regexp_replace(F.base64("value"), r"[\r\n]", "")))


def contributors(rows: DataFrame, deviations: dict[str, Column], k: int) -> DataFrame:
    """Adds `contributors`: the names of the k largest deviations of a row, largest first, ties by name; missing ones don't count."""
    every = F.filter(F.array(*(F.struct((-d).alias("d"), F.lit(n).alias("n")) for n, d in deviations.items())), lambda x: x["d"].isNotNull())
    return rows.withColumn("contributors", F.array_join(F.transform(F.slice(F.array_sort(every), 1, k), lambda x: x["n"]), ","))


def top_classes(rows: DataFrame, probabilities: dict[str, Column]) -> DataFrame:
    """Adds `first`, `second` (class names, ties by name) and `whole`, whether the probabilities add up to 1 within a millionth."""
    every = F.array_sort(F.array(*(F.struct((-p).alias("p"), F.lit(n).alias("n")) for n, p in probabilities.items())))
    total = F.lit(0.0)
    for p in probabilities.values():
        total = total + p
    return rows.withColumn("first", every[0]["n"]).withColumn("second", every[1]["n"]).withColumn("whole", F.abs(total - 1) <= 1e-6)


def select_best(candidates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row: the candidate that is least in a lexicographic order, ties by name."""
    return candidates.agg(F.min_by(key, F.struct(*order, F.col(key))).alias("chosen"), F.count("*").alias("candidates"))


def stratified_folds(rows: DataFrame, klass: str, key: str, folds: int, seed: str) -> DataFrame:
    """Adds `fold`: rows of a class are dealt out in the order of a seeded hash, bucket by bucket, so that every fold has its share of each
    class. No task sorts a class: buckets of the hash are counted, and a row's place is its bucket's start and its place inside."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(klass), F.col(key).cast("string")), 256)
    r = rows.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, 3))
    sizes = r.groupBy(klass, "_bucket").agg(F.count("*").alias("_n"))  # 4096 for each class at most
    before = F.sum("_n").over(Window.partitionBy(klass).orderBy("_bucket")) - F.col("_n")
    sizes = sizes.select(klass, "_bucket", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(klass, "_bucket").orderBy("_h")) - 1
    out = r.withColumn("_i", inside).join(sizes, [klass, "_bucket"])
    return out.withColumn("fold", ((F.col("_before") + F.col("_i")) % folds).cast("int")).drop("_h", "_bucket", "_before", "_i")


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: cases in both, mean of each and of the difference a - b, and how often a is better, equal, worse."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    d = F.col("_a") - F.col("_b")
    return j.agg(F.count("*").alias("cases"), F.round(F.avg("_a"), 6).alias("mean_a"), F.round(F.avg("_b"), 6).alias("mean_b"), F.round(F.avg(d), 6).alias("difference"), F.count_if(d > 0).alias("better"), F.count_if(d == 0).alias("equal"), F.count_if(d < 0).alias("worse"))
