"""Robust baselines, deviations, thresholds, splits and evaluation of anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ranks import by_group, join_null_safe, placed, running

#: A quantile sketch's accuracy: a bracket around a quantile holds 0.06 % of a group's rows.
ACCURACY = 10_000


def quantiles(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles of each group, interpolated linearly; null in a group without values.

    No task holds a group: equal values are counted before they are shuffled; sketches give a bracket around each quantile's place, rows below
    it are counted, and only the bracket's distinct values are ranked, 0.06 % of a large group at most."""
    v, keys = F.col(value).cast("double"), [f"_k{i}" for i in range(len(by))]
    named = rows.where(v.isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), v.alias("_v"))
    known = named.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    # of each group and quantile: its place, and the edges of the bracket around it
    spread, small = 2.0 / ACCURACY, F.col("_n") < 4 * ACCURACY  # a small group is its own bracket
    marks = F.array(*(F.lit(min(1.0, max(0.0, q + s * spread))) for q in qs for s in (-1, 1)))
    edges = named.groupBy(*(F.col(k).alias(f"_j{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n"), F.percentile_approx("_v", marks, ACCURACY).alias("_e"))
    bracket = F.array(*(F.struct(F.lit(i).alias("_q"), ((F.col("_n") - 1) * F.lit(q)).alias("_at"), F.when(small, F.lit(float("-inf"))).otherwise(F.col("_e")[2 * i]).alias("_lo"), F.when(small, F.lit(float("inf"))).otherwise(F.col("_e")[2 * i + 1]).alias("_hi")) for i, q in enumerate(qs)))
    edges = by_group(edges.select(*(f"_j{i}" for i in range(len(keys))), "_n", bracket.alias("_b")), "edges")
    same = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    # each distinct value, counted, once for each quantile whose bracket it doesn't exceed; values below a bracket as one
    met = (known.join(edges, same) if same else known.join(F.broadcast(edges))).select(*keys, "_n", "_v", "_c", F.explode("_b").alias("_x")).where(F.col("_v") <= F.col("_x._hi"))
    met = met.withColumn("_v", F.when(F.col("_v") < F.col("_x._lo"), F.lit(float("-inf"))).otherwise(F.col("_v")))
    met = met.groupBy(*keys, "_n", F.col("_x._q").alias("_q"), F.col("_x._at").alias("_at"), "_v").agg(F.sum("_c").alias("_c"))
    run = met.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v")))
    place = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    found = run.groupBy(*keys, "_n", "_q", "_at").agg(place(F.floor("_at")).alias("_low"), place(F.ceil("_at")).alias("_high"))
    part = F.col("_at") - F.floor("_at")
    found = found.withColumn("_r", F.col("_low") + (F.col("_high") - F.col("_low")) * part)
    out = found.groupBy(*keys, "_n").agg(*(F.max(F.when(F.col("_q") == i, F.col("_r"))).alias(f"q{i}") for i in range(len(qs))))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), F.col("_n").alias("n"), *(f"q{i}" for i in range(len(qs))))


def robust_baseline(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, center, scale, informative): median, and 1.4826 MAD, else IQR / 1.349, else 1.0 and uninformative. Quantiles are exact and
    no task holds a group's values; the second pass joins each row to its center by the same keys, null ones included."""
    a = by_group(quantiles(rows, by, value, (0.25, 0.5, 0.75)), "centers")
    centers = a.select(*by, F.col("q1").alias("_center"))
    apart = join_null_safe(rows, centers, by).select(*by, F.abs(F.col(value) - F.col("_center")).alias("_apart"))
    mad = quantiles(apart, by, "_apart", (0.5,)).select(*by, (F.col("q0") * 1.4826).alias("mad"))
    iqr = (F.col("q2") - F.col("q0")) / 1.349
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(iqr > 0, iqr).otherwise(1.0)
    return join_null_safe(a, mad, by).select(*by, "n", F.col("q1").alias("center"), scale.alias("scale"), ((F.col("mad") > 0) | (iqr > 0)).alias("informative"))


def deviations(rows: DataFrame, base: DataFrame, wide: DataFrame, by: list[str], wide_by: list[str], value: str, least: int = 5) -> DataFrame:
    """Adds `deviation` to rows: against the finer baseline if it stands on `least` rows, else the wider one. An uninformative baseline gives
    0; a missing one gives null."""
    f = base.where(F.col("n") >= least).select(*by, F.struct("center", "scale", "informative").alias("_f"))
    g = wide.select(*wide_by, F.struct("center", "scale", "informative").alias("_g"))
    out = rows.join(f, by, "left").join(g, wide_by, "left").withColumn("_b", F.coalesce("_f", "_g"))
    d = F.when(F.col("_b.informative"), F.abs(F.col(value) - F.col("_b.center")) / F.col("_b.scale")).when(F.col("_b").isNotNull(), 0.0)
    return out.withColumn("deviation", d).drop("_f", "_g", "_b")


def order_statistics(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row (n, lower, higher): the exact order statistics beside position (n - 1) * q; none on no values. A quantile sketch of error 1 / 10,000 gives a bracket of
    0.4 % of the rows around the position; rows below are counted, and only the bracket's distinct values are ranked, by ranges."""
    edges = rows.agg(F.count(value).alias("n"), F.percentile_approx(value, F.array(F.lit(max(0.0, q - 0.002)), F.lit(min(1.0, q + 0.002))), 10000).alias("_e"))
    v = F.col(value)
    key = F.when(v < F.col("_e")[0], F.lit(float("-inf"))).when(v <= F.col("_e")[1], v.cast("double"))
    counts = rows.where(v.isNotNull()).join(F.broadcast(edges)).groupBy("n", key.alias("_v")).agg(F.count("*").alias("c")).where("_v is not null")
    run = running(counts, ["_v"], {"upto": F.col("c")})
    place = (F.col("n") - 1) * F.lit(q)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("_v")))
    return run.groupBy("n").agg(at(F.floor(place)).alias("lower"), at(F.ceil(place)).alias("higher"))


def threshold(rows: DataFrame, score: str, fpr: float) -> DataFrame:
    """One row: the smallest score at or above the quantile 1 - fpr, and the share strictly above."""
    cut = order_statistics(rows, score, 1 - fpr).select(F.col("higher").alias("threshold"), "n")
    return rows.join(F.broadcast(cut)).groupBy("threshold", "n").agg(F.count_if(F.col(score) > F.col("threshold")).alias("above")).withColumn("fpr", F.col("above") / F.col("n"))


def binary_metrics(rows: DataFrame, truth: str, score: str, cut: float, by: list[str] = []) -> DataFrame:
    """Confusion, precision, recall, F1, false positive rate, rank-sum ROC-AUC and step-wise average precision; areas are null with one class.
    Distinct scores with their counts are summed up by ranges, so that neither a group nor the whole table meets in one task."""
    t = F.col(truth) == 1
    s = rows.groupBy(*by, score).agg(F.count_if(t).alias("p"), F.count_if(~t).alias("q"))
    s = running(s, [score], {"_p": F.col("p"), "_q": F.col("q")}, by).withColumn("lower", F.col("_q") - F.col("q"))
    s = s.withColumn("tp", F.col("_p_all") - F.col("_p") + F.col("p")).withColumn("all", F.col("tp") + F.col("_q_all") - F.col("_q") + F.col("q"))
    hit = F.col(score) > cut
    a = s.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("true_positive"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("false_positive"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("false_negative"), F.sum(F.when(hit, 0).otherwise(F.col("q"))).alias("true_negative"),
        F.sum(F.col("p") * (F.col("lower") + F.col("q") / 2)).alias("u"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"),
    )
    pos, neg = F.col("true_positive") + F.col("false_negative"), F.col("true_negative") + F.col("false_positive")
    precision, recall = F.try_divide("true_positive", F.col("true_positive") + F.col("false_positive")), F.try_divide("true_positive", pos)
    return a.select(*by, "true_positive", "false_positive", "false_negative", "true_negative", *(F.round(c, 6).alias(k) for k, c in (("precision", F.coalesce(precision, F.lit(0.0))), ("recall", F.coalesce(recall, F.lit(0.0))), ("f1", F.coalesce(F.try_divide(2 * F.col("true_positive"), 2 * F.col("true_positive") + F.col("false_positive") + F.col("false_negative")), F.lit(0.0))), ("fpr", F.coalesce(F.try_divide("false_positive", neg), F.lit(0.0))), ("roc_auc", F.try_divide("u", pos * neg)), ("average_precision", F.when(neg > 0, F.try_divide("ap", pos))))))


def localization(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, best_rank, hit1, hit3, reciprocal): services of a run by (-highest score, name), against (run_id, service_name) expected."""
    best = scored.groupBy("run_id", "service_name").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "service_name")))
    r = ranked.join(expected, ["run_id", "service_name"], "left_semi").groupBy("run_id").agg(F.min("rank").alias("best_rank"))
    return r.select("run_id", "best_rank", (F.col("best_rank") <= 1).cast("int").alias("hit1"), (F.col("best_rank") <= 3).cast("int").alias("hit3"), F.round(1 / F.col("best_rank"), 6).alias("reciprocal"))


def hash_split(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Deterministic shuffle inside each group by sha256(seed:group:key): first to validation, second to test, the rest to train."""
    ranked = placed(rows, [F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(key).cast("string")), 256)], [group])
    return ranked.withColumn("split", F.when(F.col("place") == 1, "validation").when(F.col("place") == 2, "test").otherwise("train"))


def multiclass_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """By class: support, precision, recall, F1 from the confusion counts."""
    c = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    t = c.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("chosen"))
    j = t.join(p, "class", "full").select("class", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "hit", "chosen")))
    prec, rec = F.coalesce(F.try_divide("hit", "chosen"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return j.select("class", "support", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)), 6).alias("f1"))


def multiclass_summary(rows: DataFrame, truth: str, predicted: str, probability: str) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted F1, and the log loss of the true class's probability, which is clipped at 1e-15."""
    c = multiclass_metrics(rows, truth, predicted)
    by_class = c.agg(F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 5).alias("balanced_accuracy"), F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 5).alias("weighted_f1"))
    loss = -F.log(F.greatest(F.least(F.col(probability), F.lit(1 - 1e-15)), F.lit(1e-15)))
    a = rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col(truth) == F.col(predicted)).cast("int")), 6).alias("accuracy"), F.round(F.avg(loss), 6).alias("log_loss"))
    return a.join(by_class)


def holdout(rows: DataFrame, group: str, key: str, fresh: str, seed: str, k: int = 2) -> DataFrame:
    """Adds `place` and `split`: k test rows of each group by least sha256(seed:group:key), of fresh rows only if the group has k of them."""
    n = rows.groupBy(group).agg(F.count_if(fresh).alias("_fresh"))
    r = join_null_safe(rows, n, [group]).withColumn("_later", ~F.col(fresh) & (F.col("_fresh") >= k)).drop("_fresh")
    ranked = placed(r, ["_later", F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(key).cast("string")), 256)], [group])
    return ranked.withColumn("split", F.when(F.col("place") <= k, "test").otherwise("development")).drop("_later")


def split_cover(splits: DataFrame, rows: DataFrame, key: str, split: str) -> DataFrame:
    """One row: ids in several splits, ids of `rows` in none, ids of splits that `rows` lacks, and whether the cover is exact. Null ids don't count."""
    u = splits.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("_splits"))
    known = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))
    c = known.join(u, key, "full").agg(F.count_if(F.col("_splits") > 1).alias("shared"), F.count_if(F.col("_splits").isNull()).alias("uncovered"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return c.withColumn("exact", (F.col("shared") == 0) & (F.col("uncovered") == 0) & (F.col("unknown") == 0))
