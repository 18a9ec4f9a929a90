"""Checks of run manifests, scenario catalogs, campaign plans and captures, states of analysis runs, and datasets with identities."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed file of each signal, and the key of its records.
SIGNALS = {"metrics": ("metrics.jsonl", "resourceMetrics"), "logs": ("logs.jsonl", "resourceLogs"), "traces": ("traces.jsonl", "resourceSpans")}
#: Fixed final states of an analysis run.
FINAL = ("NO_ANOMALY_SIGNAL", "GROUNDED_ADVISORY", "INSUFFICIENT_EVIDENCE", "FAILED")
_MANIFEST = "schema_version int, run_id string, scenario string, label string, validation_status string, duration_seconds int, signals map<string, string>, feature_flag struct<restored: boolean>"
_RESOURCE = "array<struct<resource: struct<attributes: array<struct<key: string, value: struct<stringValue: string>>>>>>"


def manifest_error(text: Column, folder: Column, scenarios: list[str]) -> Column:
    """First rule that a run's manifest breaks, null if none. A missing validation status is accepted; a fault's flag must be restored,
    and a normal run must have none. Null, empty and damaged texts are invalid JSON."""
    m = F.from_json(text, _MANIFEST)
    given = F.coalesce(F.json_object_keys(F.when(m.isNotNull(), text)), F.array())
    need = ("schema_version", "run_id", "scenario", "label", "duration_seconds", "signals")
    files = [F.coalesce(m["signals"][k] == file, F.lit(False)) for k, (file, _) in SIGNALS.items()]
    holds = lambda c: F.coalesce(c, F.lit(False))
    normal = m["scenario"] == "normal"
    return (
        F.when(text.isNull() | F.try_parse_json(text).isNull(), "invalid_json").when(F.size(F.array_except(F.array(*map(F.lit, need)), given)) > 0, "missing_fields")
        .when(~holds(m["schema_version"] == 1), "unsupported_version").when(~holds(m["run_id"] == folder), "run_id_mismatch").when(~holds(m["scenario"].isin(scenarios)), "unknown_scenario")
        .when(~holds(m["label"] == m["scenario"]), "label_mismatch").when(m["validation_status"] != "PASS", "not_passed").when(~holds(m["duration_seconds"] > 0), "invalid_duration")
        .when(~(files[0] & files[1] & files[2]), "signal_file_mismatch").when(normal & m["feature_flag"].isNotNull(), "unexpected_flag").when(~normal & ~holds(m["feature_flag"]["restored"]), "flag_not_restored")
    )


def catalog_errors(scenarios: DataFrame) -> DataFrame:
    """(name, error) of a catalog with name, label, description, flag, variant, baseline: blank fields, repeated names, incomplete flags, a normal
    scenario with a flag, flags whose baselines differ between scenarios, and one row without a name where the normal scenario is missing."""
    blank = lambda *cs: F.greatest(*(F.coalesce(F.col(c), F.lit("")) == "" for c in cs))
    names = scenarios.groupBy("name").agg(F.count("*").alias("_n"), F.max(blank("name", "label", "description")).alias("_blank"), F.max(F.col("flag").isNotNull() & blank("flag", "variant", "baseline")).alias("_part"), F.max(F.col("flag").isNotNull()).alias("_flag"))
    rules = F.array_compact(F.array(F.when(F.col("_blank"), "blank_field"), F.when(F.col("_n") > 1, "duplicate_name"), F.when(F.col("_part"), "incomplete_flag"), F.when((F.col("name") == "normal") & F.col("_flag"), "normal_with_flag")))
    flags = scenarios.where("flag is not null").groupBy("flag").agg(F.count_distinct("baseline").alias("_n")).where("_n > 1").select("flag")
    torn = scenarios.join(flags, "flag", "left_semi").select("name", F.lit("conflicting_baseline").alias("error")).distinct()
    missing = scenarios.agg(F.count_if(F.col("name") == "normal").alias("_n")).where("_n = 0").select(F.lit(None).cast("string").alias("name"), F.lit("normal_missing").alias("error"))
    return names.select("name", F.explode(rules).alias("error")).unionByName(torn).unionByName(missing)


def campaign_errors(required: DataFrame, order: DataFrame, existing: DataFrame) -> DataFrame:
    """(scenario, required, ordered, existing, error): required (scenario, runs), ordered (scenario), accepted (run_id, scenario). The first of:
    not required, ordered other than required, an accepted run listed more than once, more accepted than required."""
    repeated = existing.groupBy("run_id").agg(F.count("*").alias("_n")).where("_n > 1").select("run_id", F.lit(1).alias("_twice"))
    e = existing.join(repeated, "run_id", "left").groupBy("scenario").agg(F.count("*").alias("existing"), F.count("_twice").alias("_twice"))
    r, o = required.select("scenario", F.col("runs").alias("required")), order.groupBy("scenario").agg(F.count("*").alias("ordered"))
    j = r.join(o, "scenario", "full").join(e, "scenario", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    error = F.when(F.col("required").isNull(), "unknown_scenario").when(n("required") != n("ordered"), "order_mismatch").when(n("_twice") > 0, "duplicate_existing").when(n("existing") > n("required"), "over_quota")
    return j.select("scenario", *(n(c).alias(c) for c in ("required", "ordered", "existing")), error.alias("error"))


def capture_counts(lines: DataFrame) -> DataFrame:
    """(run_id, signal, batches, broken, services) of (run_id, signal, line): blank lines don't count, lines whose root is no list are broken, services
    are the sorted non-empty names of the others."""
    roots = [root for _, root in SIGNALS.values()]
    v = F.from_json("line", ", ".join(f"{k} {_RESOURCE}" for k in roots))
    root = F.coalesce(*(F.when(F.col("signal") == s, v[k]) for s, (_, k) in SIGNALS.items()))
    attributes = F.flatten(F.transform(root, lambda x: F.coalesce(x["resource"]["attributes"], F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>"))))
    found = F.transform(F.filter(attributes, lambda a: (a["key"] == "service.name") & (a["value"]["stringValue"] != "")), lambda a: a["value"]["stringValue"])
    r = lines.where(F.trim("line") != "").select("run_id", "signal", root.isNull().alias("_broken"), F.posexplode_outer(F.array_distinct(found)).alias("_at", "_service"))
    # one row for each service of a line: a line is counted at its first
    one = F.coalesce(F.col("_at"), F.lit(0)) == 0
    first = r.groupBy("run_id", "signal", "_service").agg(F.count_if(one & F.col("_broken")).alias("_broken"), F.count_if(one).alias("_n"))
    names = F.array_sort(F.collect_set("_service"))
    return first.groupBy("run_id", "signal").agg(F.sum("_n").alias("batches"), F.sum("_broken").alias("broken"), names.alias("services"))


def capture_errors(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, error) by `capture_counts` and (run_id, services expected): a signal without whole lines, broken lines, no service, an expected one unseen."""
    c = counts.groupBy("run_id").agg(F.count_if(F.col("batches") > F.col("broken")).alias("_signals"), F.sum("broken").alias("_broken"), F.array_distinct(F.flatten(F.collect_list("services"))).alias("_seen"))
    j = expected.select("run_id", F.col("services").alias("_expected")).join(c, "run_id", "left")
    error = F.when(F.coalesce(F.col("_signals"), F.lit(0)) < len(SIGNALS), "signal_missing").when(F.col("_broken") > 0, "broken_lines").when(F.size("_seen") == 0, "no_service").when(F.size(F.array_except("_expected", "_seen")) > 0, "expected_service_unseen")
    return j.select("run_id", error.alias("error"))


def readiness(windows: DataFrame, durations: DataFrame, required: dict[str, int], normal_windows: int, excluded: list[str]) -> DataFrame:
    """One row over windows (run_id, scenario, service_name) and (run_id, duration_seconds): runs with several scenarios, scenarios with fewer runs than
    required, windows of normal runs and eligible services, excluded services seen, different durations, and whether all holds."""
    runs = windows.groupBy("run_id").agg(F.min("scenario").alias("scenario"), (F.min("scenario") != F.max("scenario")).alias("_torn"))
    per = [F.count_if(F.col("scenario") == s).alias(f"_{i}") for i, s in enumerate(required)]
    short = F.array_compact(F.array(*(F.when(F.col(f"_{i}") < n, s) for i, (s, n) in enumerate(required.items()))))
    a = runs.agg(F.count("*").alias("runs"), F.count_if("_torn").alias("conflicts"), *per).select("runs", "conflicts", F.array_join(short, ",").alias("short"))
    left_out = F.col("service_name").isin(excluded)
    b = windows.agg(F.count_if((F.col("scenario") == "normal") & ~left_out).alias("normal_windows"), F.count_distinct(F.when(left_out, F.col("service_name"))).alias("excluded_services"))
    c = durations.join(runs.select("run_id"), "run_id", "left_semi").agg(F.count_distinct("duration_seconds").alias("durations"))
    ready = (F.col("conflicts") == 0) & (F.col("short") == "") & (F.col("normal_windows") >= normal_windows) & (F.col("durations") <= 1)
    return a.join(b).join(c).withColumn("ready", ready)


def run_states(events: DataFrame, key: str, order: list[str], state: str, code: str) -> DataFrame:
    """Analysis runs after all events: the last state (PENDING without any), place of the last final one, its failure code (cleared by a success), and
    timeline entries. Later events overwrite; a restart keeps the completion before it."""
    at = F.struct(*order)
    final = F.col(state).isin(*FINAL)
    last = F.max_by(F.when(F.col(state) == "FAILED", F.col(code)), F.when(final, at))
    return events.groupBy(key).agg(F.coalesce(F.max_by(state, at), F.lit("PENDING")).alias("status"), F.max(F.when(final, at)).getField(order[0]).alias("completed_at"), last.alias("failure_code"), F.count("*").alias("entries"))


def digest(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, rows, digest): an identity of a set of rows that needs neither order nor a group in one task. Four 32-bit words of each row's sha256 are summed,
    and the sums hashed with the count; columns count as text in the order given, nulls as a zero byte."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns))
    words = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    r = rows.select(*by, F.sha2(text, 256).alias("_h")).groupBy(*by).agg(F.count("*").alias("rows"), *(F.sum(w).alias(f"_{i}") for i, w in enumerate(words)))
    sums = (F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4))
    return r.select(*by, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *sums), 256).alias("digest"))


def dataset_id(prefix: str, settings: dict, content: Column) -> Column:
    """Prefix and the first 12 hex digits of sha256 over canonical JSON: keys in order, no blanks; `content` stands under the key "content"."""
    before = json.dumps({k: v for k, v in settings.items() if k < "content"}, sort_keys=True, separators=(",", ":"))[1:-1]
    after = json.dumps({k: v for k, v in settings.items() if k > "content"}, sort_keys=True, separators=(",", ":"))[1:-1]
    text = F.concat(F.lit("{" + (before + "," if before else "") + '"content":"'), content, F.lit('"' + ("," + after if after else "") + "}"))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 12))


def write_dataset(rows: DataFrame, path: str, prefix: str, settings: dict) -> None:
    """Rows as zstd Parquet at path/rows, and a manifest of one JSON row at path/manifest, made of what was written. Never overwrites."""
    rows.write.option("compression", "zstd").parquet(f"{path}/rows")
    made = digest(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows"))
    made.withColumn("dataset_id", dataset_id(prefix, settings, F.col("digest"))).coalesce(1).write.json(f"{path}/manifest")


def verify_dataset(spark: SparkSession, path: str, schema, prefix: str, settings: dict) -> DataFrame:
    """One row: the manifest's id and rows, and whether count, digest and id computed again from the files agree."""
    m = spark.read.schema("rows long, digest string, dataset_id string").json(f"{path}/manifest")
    d = digest(spark.read.schema(schema).parquet(f"{path}/rows")).select(F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    same = (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")) & (F.col("dataset_id") == dataset_id(prefix, settings, F.col("_digest")))
    return m.join(d).select("dataset_id", "rows", same.alias("whole"))
