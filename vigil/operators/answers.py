"""Scores of grounded answers: citations, abstention, groups, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def citation_scores(rows: DataFrame, key: str, cited: str, gold: str) -> DataFrame:
    """(key, cited, relevant, precision, recall) of two arrays, each taken as a set; 0.0 on an empty side."""
    hit = F.size(F.array_intersect(cited, gold))
    a, b = F.size(F.array_distinct(cited)), F.size(F.array_distinct(gold))
    z = lambda n, d: F.round(F.coalesce(F.try_divide(n, d), F.lit(0.0)), 6)
    return rows.select(key, a.alias("n_cited"), b.alias("n_gold"), z(hit, a).alias("precision"), z(hit, b).alias("recall"))


def abstention(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """One row: answered and abstained, rightly and wrongly, and their rates; null where there is no such case."""
    e, g = F.col(expected), F.col(got)
    c = rows.agg(F.count_if(e & g).alias("right_answer"), F.count_if(e & ~g).alias("wrong_abstention"), F.count_if(~e & g).alias("wrong_answer"), F.count_if(~e & ~g).alias("right_abstention"))
    r = lambda n, *d: F.round(F.try_divide(F.col(n), sum((F.col(x) for x in d[1:]), F.col(d[0]))), 6)
    return c.select("*", r("right_abstention", "right_abstention", "wrong_abstention").alias("abstention_precision"), r("right_abstention", "right_abstention", "wrong_answer").alias("abstention_recall"), r("wrong_answer", "wrong_answer", "right_abstention").alias("unsupported_rate"), r("wrong_abstention", "wrong_abstention", "right_answer").alias("refusal_rate"))


def micro_macro(rows: DataFrame, by: str, hits: str, total: str) -> DataFrame:
    """(by, cases, micro, macro): ratio of sums, and mean of ratios."""
    return rows.groupBy(by).agg(F.count("*").alias("cases"), F.round(F.try_divide(F.sum(hits), F.sum(total)), 6).alias("micro"), F.round(F.avg(F.try_divide(F.col(hits), F.col(total))), 6).alias("macro"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(rows: DataFrame, value: str, resamples: int = 10_000, seed: int = 17, level: float = 0.95) -> DataFrame:
    """One row (estimate, lower, upper) of a mean: Poisson bootstrap. Each row counts in each resample by a weight drawn from its own content and
    the seed, so resamples need one pass and partial sums, however many rows there are."""

    k = np.arange(20)
    cdf = np.cumsum(np.exp(-1.0) / np.array([math.factorial(int(i)) for i in k]))
    draws = _mixed(np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def run(frames):
        sums, weights = np.zeros(resamples), np.zeros(resamples)
        for f in frames:
            v, h = f["v"].to_numpy(), f["h"].to_numpy().astype(np.uint64)
            for a in range(0, len(v), 256):
                u = _mixed(h[a : a + 256, None] ^ draws[None, :]) >> np.uint64(11)
                w = np.searchsorted(cdf, u.astype(np.float64) * 2.0**-53)  # weights of rows in resamples
                sums, weights = sums + v[a : a + 256] @ w, weights + w.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(resamples), "s": sums, "w": weights})

    r = rows.select(F.col(value).cast("double").alias("v"), F.xxhash64(*rows.columns).alias("h")).where("v is not null")
    means = r.mapInPandas(run, "i int, s double, w double").groupBy("i").agg((F.sum("s") / F.sum("w")).alias("m"))
    edges = means.agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("p"))
    return r.agg(F.avg("v").alias("estimate")).join(edges).select("estimate", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))
