"""Estimators: exact medians and imputation, an isolation forest, MLlib classifiers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.anomaly import order_statistics
from vigil.operators.forest import random_forest


def medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column, 0.0 where all of it is missing."""
    out = None
    for c in columns:
        s = order_statistics(rows, c, 0.5)
        m = s.agg(F.coalesce(F.avg((F.col("lower") + F.col("higher")) / 2), F.lit(0.0)).alias(c))
        out = m if out is None else out.join(m)  # single rows
    return out


def impute(rows: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """Missing values become the column's median, over the rows of `known` where given."""
    m = medians(rows if known is None else known, columns).select(*(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(F.broadcast(m)).select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in rows.columns))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A node (column, cut, left, right), or a leaf (number of rows,)."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth == 0 or not len(spread):
        return (len(x),)
    c = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    left = x[:, c] <= cut
    return c, cut, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _flat(tree: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree as arrays (column, cut, left child, depth of a row that ends there), the right child beside the left one, and its levels; a leaf is its own child, whatever the row."""
    nodes, column, cut, left, ends, levels = [(tree, 0)], [], [], [], [], 0
    for at, (node, depth) in enumerate(nodes):  # grows while it is read
        leaf, levels = len(node) == 1, max(levels, depth)
        column.append(0 if leaf else node[0])
        cut.append(math.inf if leaf else node[1])
        left.append(at if leaf else len(nodes))
        ends.append(depth + expected_depth(node[0]) if leaf else 0.0)
        if not leaf:
            nodes += [(node[2], depth + 1), (node[3], depth + 1)]
    return np.array(column), np.array(cut), np.array(left), np.array(ends), levels


def _depth_sums(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Of each row, its depths in all trees. Rows go down a tree level by level, all at once, a few thousand at a time."""
    out = np.zeros(len(x))
    for low in range(0, len(x), 4096):
        part = np.ascontiguousarray(x[low : low + 4096])
        flat, start = part.ravel(), np.arange(len(part)) * part.shape[1]
        for column, cut, left, ends, levels in trees:
            at = np.zeros(len(part), np.int64)
            for _ in range(levels):
                at = left.take(at) + (flat.take(start + column.take(at)) > cut.take(at))
            out[low : low + 4096] += ends.take(at)
    return out


def _least(rows: DataFrame, lot, key: list[str], most: int) -> DataFrame:
    """The `most` rows of least lot, a 64-bit hash. Only rows below a mark that the number of rows gives are sorted; all of them only if chance left too few there."""
    n = rows.count()
    share = (most + 8 * math.sqrt(most) + 64) / max(n, 1)
    if share < 0.5:
        few = rows.where(lot < int(-(2**63) + share * 2**64))
        if few.count() >= most:
            rows = few
    return rows.orderBy(lot, *key).limit(most)


def isolation_forest(rows: DataFrame, key: list[str], columns: list[str], trees: int = 300, sample: int = 256, seed: int = 17) -> DataFrame:
    """(key, score): isolation forest over complete rows. Every row is scored; a tree grows from `sample` rows, a parameter of the method. They are the
    trees * sample rows of least seeded hash, so fitting data are bounded and reruns agree."""
    known = rows.dropna(subset=columns).select(*key, *(F.col(c).cast("double").alias(c) for c in columns))
    lot = F.xxhash64(F.lit(seed), *key)
    drawn = _least(known, lot, key, trees * sample).select(*columns).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    k = min(sample, len(drawn))
    grown = [_grow(drawn[rng.choice(len(drawn), k, replace=False)], rng, math.ceil(math.log2(max(k, 2)))) for _ in range(trees)] if k else []
    forest = rows.sparkSession.sparkContext.broadcast([_flat(t) for t in grown])
    norm = max(expected_depth(k), 1e-12)

    def run(frames):
        for f in frames:
            out = _depth_sums(forest.value, f[columns].to_numpy())
            yield f[key].assign(score=2.0 ** (-out / max(len(forest.value), 1) / norm))

    kinds = dict(known.dtypes)
    return known.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in key), "score double"]))


def classify(rows: DataFrame, key: list[str], columns: list[str], label: str, kind: str = "logistic", held_out: str = "held_out", seed: int = 17) -> DataFrame:
    """(key, label, held_out, probability, predicted): a classifier of `label` 0/1, trained on rows that aren't held out. Missing
    values, NaN included, become the medians of those rows, so every row is scored. Logistic regression, MLlib's over standardized columns, has up to 2000 iterations and
    the penalty 1 / rows; the forest 300 trees of depth 5 over 32 bins of each column, at least 2 rows in a leaf, and weights that balance the classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) if c in columns else c for c in rows.columns]
    rows = rows.select(*whole)
    rows = impute(rows, columns, rows.where(~F.col(held_out)))
    learned = rows.where(~F.col(held_out))
    count = {r[0]: r[1] for r in learned.groupBy(label).agg(F.count("*")).collect()}
    n = sum(count.values())
    if kind == "forest":
        scored = random_forest(learned, rows, columns, label, {float(k): n / (len(count) * c) for k, c in count.items()}, seed=seed)
        return scored.select(*key, label, held_out, "probability", (F.col("probability") > 0.5).cast("int").alias("predicted"))
    last = LogisticRegression(featuresCol="x", labelCol=label, maxIter=2000, regParam=1 / max(n, 1), standardization=False)
    steps = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), last])
    scored = steps.fit(learned).transform(rows)
    return scored.select(*key, label, held_out, vector_to_array("probability")[1].alias("probability"), F.col("prediction").cast("int").alias("predicted"))
