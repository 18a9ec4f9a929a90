"""A random forest over binned rows: rows of equal bins and label are one cell with a count, and a tree's bootstrap draws each cell as often as its rows would be."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.sources.tables import written

#: Cells that a task draws at once, and bytes of sums that it holds.
CHUNK, HELD = 1000, 64 << 20


def thresholds(rows: DataFrame, columns: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Of each column, ascending values that begin a bin: all but the least where there are at most `bins`, otherwise quantiles within 0.1 % of the rows."""
    about = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    few = [c for c in columns if about[c] <= 2 * bins]
    values = rows.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in few)).first() if few else {}
    many = [c for c in columns if c not in few or len(values[c]) > bins]
    at = dict(zip(many, rows.approxQuantile(many, [i / bins for i in range(bins)], 0.001))) if many else {}
    return {c: sorted(set(at.get(c) or values[c]))[1:] for c in columns}


def binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """The rows with an int column _b0, _b1, ... for each column's bin."""
    names = [f"_b{i}" for i in range(len(cuts))]
    edges = [[-math.inf, *(t or [math.inf]), *([math.inf] if t and t[-1] < math.inf else [])] for t in cuts.values()]
    edges = [e if len(e) > 2 else [-math.inf, 0.0, math.inf] for e in edges]  # a column of one value has one bin that counts
    out = Bucketizer(splitsArray=edges, inputCols=[*cuts], outputCols=names, handleInvalid="error").transform(rows)
    return out.withColumns({n: (F.col(n).cast("int") if t else F.lit(0)) for n, t in zip(names, cuts.values())})


class Trees:
    """Trees as arrays over heap places (children of i: 2i + 1, 2i + 2): a column, -1 in a leaf, the first bin that goes right, and the share of label 1."""

    def __init__(self, trees: int, depth: int):
        self.column, self.cut, self.share = np.full((trees, 2 ** (depth + 1) - 1), -1), np.zeros((trees, 2 ** (depth + 1) - 1), np.int64), np.full((trees, 2 ** (depth + 1) - 1), 0.5)

    def places(self, bins: np.ndarray, low: int, high: int, levels: int) -> np.ndarray:
        """Of each row (bins by column) and tree low to high - 1 its place after at most so many levels."""
        of, at = np.arange(low, high), np.zeros((len(bins), high - low), np.int64)
        row = np.arange(len(bins))[:, None]
        for _ in range(levels):
            c = self.column[of, at]
            at = np.where(c < 0, at, 2 * at + 1 + (bins[row, c] >= self.cut[of, at]))
        return at

    def prune(self) -> None:
        """As MLlib does, two leaves that predict the same label become one, from the bottom up."""
        for i in reversed(range(self.column.shape[1] // 2)):
            left, right = 2 * i + 1, 2 * i + 2
            same = (self.column[:, i] >= 0) & (self.column[:, left] < 0) & (self.column[:, right] < 0) & ((self.share[:, left] > 0.5) == (self.share[:, right] > 0.5))
            self.column[same, i] = -1


def _sums(trees: Trees, bins: np.ndarray, label: np.ndarray, drawn: np.ndarray, low: int, high: int, level: int, sizes: list[int]) -> np.ndarray:
    """Drawn rows by tree, node of the level, bin (one column's after the other's) and label."""
    first, nodes, offsets = 2**level - 1, 2**level, np.cumsum([0, *sizes])
    at = trees.places(bins, low, high, level)
    live = (at >= first) & (drawn > 0)
    row, tree = np.nonzero(live)
    node = tree * nodes + at[live] - first
    out = np.zeros(((high - low) * nodes, offsets[-1], 2))
    for i, size in enumerate(sizes):
        out[:, offsets[i] : offsets[i + 1]] = np.bincount((node * size + bins[row, i]) * 2 + label[row], drawn[live], len(out) * size * 2).reshape(len(out), size, 2)
    return out.reshape(high - low, nodes, offsets[-1], 2)


def best_split(sums: np.ndarray, weight: np.ndarray, sizes: list[int], columns: np.ndarray, least: int) -> tuple[int, int, float, float]:
    """(column, first bin to the right, share of label 1 left, right) of the split of one node (bin, label) that lowers the weighted Gini impurity most; column -1 if none does."""
    best, found, offsets = 1e-12, (-1, 0, 0.5, 0.5), np.cumsum([0, *sizes])
    for c in columns:
        left = np.cumsum(sums[offsets[c] : offsets[c + 1]], 0)
        left, whole = left[:-1], left[-1]
        right = whole - left
        l, r, t = left * weight, right * weight, whole * weight
        pure = lambda x: (x**2).sum(-1) / np.maximum(x.sum(-1), 1e-300)
        gain = np.where((left.sum(1) >= least) & (right.sum(1) >= least), (pure(l) + pure(r) - pure(t)) / max(t.sum(), 1e-300), 0)
        if len(gain) and gain.max() > best:
            k = int(gain.argmax())
            best, found = gain[k], (int(c), k + 1, l[k, 1] / l[k].sum(), r[k, 1] / r[k].sum())
    return found


def _splitter(level: int, sizes: list[int], weight: np.ndarray, tried: int, least: int, seed: int):
    """One tree's splits of a level from all tasks' sums."""

    def split(key, frame):
        tree, out = int(key[0]), []
        sums = np.sum(np.stack(frame["sums"].to_list()), 0).reshape(2**level, -1, 2)
        for i in range(2**level):
            whole = sums[i, : sizes[0]].sum(0) * weight
            if whole.sum() > 0:
                columns = np.random.default_rng([seed, tree, 2**level - 1 + i]).choice(len(sizes), tried, replace=False)
                out.append((tree, 2**level - 1 + i, whole[1] / whole.sum(), *best_split(sums[i], weight, sizes, columns, least)))
        return pd.DataFrame(out, columns=["tree", "node", "share", "column", "cut", "left", "right"])

    return split


def grow(cells: DataFrame, sizes: list[int], weight: list[float], trees: int, depth: int, least: int, seed: int) -> Trees:
    """Trees grown level by level from cells (_b0, ..., _y, _n). Tasks draw a Poisson number of the count for each tree, again the same at every level, and add up; a node
    tries ceil(sqrt(columns)) columns. Only splits come to the driver."""
    spark, names, grown, w = cells.sparkSession, [f"_b{i}" for i in range(len(sizes))], Trees(trees, depth), np.array(weight)
    cells = written(cells, "cells")
    n = cells.count()
    key = F.pmod(F.xxhash64(*names, "_y"), F.lit(math.ceil(max(n, 1) / CHUNK)))
    listed = cells.groupBy(key.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(*names, "_y", "_n"))).alias("cells"))
    chunks = written(listed.repartition(2 * spark.sparkContext.defaultParallelism, "chunk"), "chunks")  # so few bytes would else be read by one task
    tried = math.ceil(math.sqrt(len(sizes)))
    for level in range(depth):
        block = max(1, HELD // (2**level * sum(sizes) * 16))
        known = spark.sparkContext.broadcast(grown)
        splits = []
        for low in range(0, trees, block):
            high = min(trees, low + block)

            def add(batches, low=low, high=high, level=level, known=known):
                total = None
                for b in batches:
                    for chunk, held in zip(b["chunk"].to_pylist(), b["cells"]):
                        x = np.stack([held.values.field(i).to_numpy() for i in range(len(sizes) + 2)], 1)
                        drawn = np.random.default_rng([seed, chunk]).poisson(x[:, -1:], (len(x), trees))[:, low:high]
                        got = _sums(known.value, x[:, :-2], x[:, -2], drawn, low, high, level, sizes)
                        total = got if total is None else total + got
                if total is not None:
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(range(low, high), pa.int32()), "sums": pa.array([t.ravel() for t in total], pa.list_(pa.float64()))})

            summed = chunks.mapInArrow(add, "tree int, sums array<double>")
            splits += summed.groupBy("tree").applyInPandas(_splitter(level, sizes, w, tried, least, seed), "tree int, node int, share double, column int, cut int, left double, right double").collect()
        for r in splits:
            grown.share[r.tree, r.node] = r.share
            if r.column >= 0:
                grown.column[r.tree, r.node], grown.cut[r.tree, r.node] = r.column, r.cut
                grown.share[r.tree, 2 * r.node + 1], grown.share[r.tree, 2 * r.node + 2] = r.left, r.right
        known.unpersist()
    grown.prune()
    return grown


def random_forest(learned: DataFrame, rows: DataFrame, columns: list[str], label: str, weights: dict[float, float], trees: int = 300, depth: int = 5, least: int = 2, seed: int = 17) -> DataFrame:
    """The rows with probability, the mean share of label 1 in their leaves. Every row of `learned` counts and every one of `rows` is scored; work of the trees follows the
    number of cells, at most that of rows, and a row only finds its bins and its cell's probability. Labels are 0 and 1; values are neither null nor NaN."""
    cuts = thresholds(learned, columns)
    sizes, names = [len(t) + 1 for t in cuts.values()], [f"_b{i}" for i in range(len(cuts))]
    cells = binned(learned, cuts).groupBy(*names, F.col(label).cast("int").alias("_y")).agg(F.count("*").alias("_n"))
    grown = rows.sparkSession.sparkContext.broadcast(grow(cells, sizes, [weights.get(0.0, 1.0), weights.get(1.0, 1.0)], trees, depth, least, seed))

    def score(batches):
        for b in batches:
            x = np.stack([b[n].to_numpy() for n in names], 1)
            parts = [grown.value.share[np.arange(trees), grown.value.places(x[i : i + 4096], 0, trees, depth)].mean(1) for i in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(np.concatenate([*parts, np.zeros(0)]))], names=[*names, "probability"])

    found = binned(rows, cuts)
    scores = written(found.select(*names).distinct().mapInArrow(score, ", ".join([*(f"{n} int" for n in names), "probability double"])), "scores")
    return found.join(scores, names).drop(*names)
