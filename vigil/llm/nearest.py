"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors.

Each ordering holds the vectors' places on the curve and small codes of them, not the vectors. A query looks at some rows
before and after its own place in every ordering, keeps the nearest by their codes, and the candidates of all orderings are ranked once by
the vectors themselves. The number of orderings is fixed, so what is placed and shuffled grows as the table; how far a query looks
depends on the data and is reckoned from a bounded sample: little where vectors lie in groups, far where they fill all directions alike."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, groups, lean, partitions
from .vectors import hashed, lengths, rows_of, sample

#: Projected dimensions of an ordering and bits of each; the share of true neighbours that the windows of all orderings are to hold by reckoning;
#: orderings; rows on either side of a query at least; rows of a range of an ordering, about.
DIMS, BITS, AIM, CURVES, REACH, RANGE_ROWS = 6, 8, 0.975, 24, 128, 50_000
#: Vectors of the sample that stand for queries when orderings are reckoned, and orderings tried.
TRIED, TRIALS = 200, 6
#: Vectors of the sample beside which codes are taken; standard deviations by which a distance by codes may be off.
ANCHORS, DOUBT = 4096, 2.0


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points with coordinates below 2**bits (rows); dimensions times bits below 64."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, coarsest first
        bit = np.int64(1) << level
        low = bit - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, low, (x[0] ^ x[i]) & low)
            x[i] ^= np.where(turned, 0, swap)
            x[0] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)  # Gray code
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> level) & 1)
    return key


class Curves:
    """Orderings of vectors of one length: random projections, cells between quantiles of a bounded sample (so that no outlier
    sets the scale), random shifts; and the reach that `total` rows need."""

    def __init__(self, fitted: np.ndarray, dim: int, total: int, k: int, seed: int, reach: int = REACH):
        self.dim, self.dims, self.seed = dim, min(DIMS, dim), seed
        self.fitted, self.edges = fitted, {}
        self.reach = self._reckon(total, k, reach)
        self.edges = {c: self._edges(c) for c in range(CURVES)}
        self.fitted = None

    def _projection(self, curve: int) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng([self.seed, self.dim, curve])
        return np.linalg.qr(r.normal(size=(self.dim, self.dims)))[0], r.integers(0, 1 << BITS, self.dims)

    def _edges(self, curve: int) -> np.ndarray:
        y = self.fitted @ self._projection(curve)[0]
        return np.quantile(y, np.arange(1, 1 << BITS) / (1 << BITS), axis=0) if len(y) else np.zeros(((1 << BITS) - 1, self.dims))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        project, shift = self._projection(curve)
        y, edges = x @ project, self.edges[curve]
        cells = np.stack([np.searchsorted(edges[:, d], y[:, d]) for d in range(self.dims)], 1)
        return hilbert_keys(cells + shift, BITS + 1)

    def _reckon(self, total: int, k: int, reach: int) -> int:
        """The reach, from how far the sample's neighbours lie from a sample vector in some orderings. A window has the same share of
        the sample as of all rows; below 16 rows of the sample, the hit rate is carried on as a power of the share."""
        m = len(self.fitted)
        if total <= 2 * reach or m <= k + 1:
            return reach
        asks = np.arange(min(TRIED, m))
        x = self.fitted
        far = np.einsum("ij,ij->i", x, x)[None, :] - 2 * x[asks] @ x.T
        far[asks, asks] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        apart = []
        for c in range(TRIALS):
            self.edges[c] = self._edges(c)
            key = self.keys(x, c)
            place = np.empty(m, np.int64)
            place[np.argsort(key, kind="stable")] = np.arange(m)
            apart.append(np.abs(place[near] - place[asks][:, None]))
        apart = np.stack(apart)
        rate = lambda rows: max(float((apart <= rows).mean()), 1e-6)
        low = min(16, m // 4)
        power = max(0.0, math.log(rate(4 * low) / rate(low)) / math.log(4)) if low else 1.0
        while 2 * reach < total:
            rows = reach * m / total
            hit = rate(rows) if rows >= low else rate(low) * (rows / low) ** power
            if (1 - hit) ** CURVES <= 1 - AIM:
                break
            reach = reach + reach // 4
        return reach


class Codes:
    """Vectors as 4-bit numbers of what is left beside an anchor: the nearest of a bounded sample, the sample's mean among them. So neither a far
    origin nor a tight knot that holds an anchor takes the codes' precision."""

    def __init__(self, fitted: np.ndarray, dim: int):
        self.dim = dim
        self.center = fitted.mean(axis=0) if len(fitted) else np.zeros(dim)
        self.anchors = np.concatenate([np.zeros((1, dim)), fitted[:ANCHORS].reshape(-1, dim) - self.center])
        self.half = np.einsum("ij,ij->i", self.anchors, self.anchors) / 2

    def coded(self, x: np.ndarray) -> np.ndarray:
        """Rows as bytes: a scale as float64, the error's length as float32, the anchor's number as int32, then 4-bit numbers, two to a byte."""
        x = x - self.center
        at = np.concatenate([np.argmin(self.half - x[i : i + 512] @ self.anchors.T, axis=1) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.int64)
        rest = x - self.anchors[at]
        top = np.abs(rest).max(axis=1)
        scale = np.where(top > 0, top, 1) / 7.5
        q = np.clip(np.floor(rest / scale[:, None]) + 8, 0, 15).astype(np.uint8)
        off = rest - (q - 7.5) * scale[:, None]
        error = np.sqrt(np.einsum("ij,ij->i", off, off)).astype(np.float32)
        if q.shape[1] % 2:
            q = np.concatenate([q, np.full((len(q), 1), 8, np.uint8)], 1)
        heads = [np.ascontiguousarray(c).view(np.uint8).reshape(len(x), -1) for c in (scale, error, at.astype(np.int32))]
        return np.concatenate([*heads, q[:, ::2] | (q[:, 1::2] << 4)], 1)

    def decoded(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors about, less the center; lengths of their errors)."""
        scale, error, at = (np.ascontiguousarray(codes[:, i:j]).view(kind)[:, 0] for i, j, kind in ((0, 8, np.float64), (8, 12, np.float32), (12, 16, np.int32)))
        q = np.stack([codes[:, 16:] & 15, codes[:, 16:] >> 4], 2).reshape(len(codes), -1)[:, : self.dim]
        return (q.astype(np.float64) - 7.5) * scale[:, None] + self.anchors[at], error.astype(np.float64)


def nearest(work: Workspace, df: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, reach: int = REACH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (over vec_id) marks, its k nearest found by Euclidean distance.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without an id; vectors of
    different lengths are searched among themselves. All rows are indexed; scales and the reach are fitted to SAMPLE vectors of
    each length. Equal vectors have one place on a curve, ask once, and stand there for their k+1 smallest ids, so a group of copies of any size is
    one row. A repeated id is listed once for each query. An empty table gives an empty result; other columns are not read.

    A window may reach over any number of ranges of an ordering: places are exact, from counts of the ranges, and a query travels to each range that its
    window touches. In a range it keeps the 4k nearest by 4-bit codes and every other vector that the codes' known error may hide among the k nearest, however many:
    so a knot of vectors closer than that error is compared in full."""
    spark = df.sparkSession
    points = work.put(hashed(df, id_col, vec_col).where("dim is not null"), "points")
    asks = F.expr(queries.replace(id_col, "id"))
    once = points.groupBy("h1", "h2", "id").agg(F.first("dim").alias("dim"), F.first("v").alias("v"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    single = ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    asked = work.put(points.where(asks).select("id", "h1", "h2").distinct(), "asked")
    single = single.join(asked.groupBy("h1", "h2").agg(F.lit(True).alias("asks")), ["h1", "h2"], "left")
    single = work.put(single.withColumn("pid", F.monotonically_increasing_id()), "single")
    counts = lengths(single)
    fitted = sample(single.withColumn("id", F.col("ids")[0]), counts)
    index = {d: Curves(fitted[d], d, n, k, seed, reach) for d, n in counts.items()}
    codes = spark.sparkContext.broadcast({d: Codes(fitted[d], d) for d in counts})
    most = 4 * k

    def place(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dim = t["dim"].to_numpy()
            for d in np.unique(dim).tolist():
                part = t.filter(pa.array(dim == d))
                x, n = rows_of(part), part.num_rows
                code = pa.array([r.tobytes() for r in codes.value[d].coded(x)], pa.binary())
                whole = pa.array([v if a else None for v, a in zip(part["v"].to_pylist(), part["asks"].to_pylist())], pa.binary())
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d)), pa.array(np.full(n, c)), pa.array(index[d].keys(x, c)), part["pid"].combine_chunks(), code, whole], names=["dim", "curve", "key", "pid", "code", "v"])

    n_ranges = sum(CURVES * max(1, -(-n // range_rows)) for n in counts.values())
    placed = single.mapInArrow(lean(place), "dim long, curve long, key long, pid long, code binary, v binary")
    placed = placed.repartitionByRange(max(n_ranges, 1), "dim", "curve", "key", "pid").sortWithinPartitions("dim", "curve", "key", "pid")
    laid = work.put(placed.select("dim", "curve", "pid", "code", "v", F.monotonically_increasing_id().alias("at")), "laid").withColumn("range", F.shiftright("at", 33))
    ranges = laid.groupBy("dim", "curve", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("dim", "curve").orderBy("range")) - F.col("n")  # a row for each range, of about range_rows rows
    ranges = ranges.select("dim", "curve", "range", "first", start.alias("start")).orderBy("dim", "curve", "range").toArrow()
    of: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    names = list(zip(ranges["dim"].to_pylist(), ranges["curve"].to_pylist()))
    for name in dict.fromkeys(names):
        here = np.flatnonzero([x == name for x in names]) if len(names) < 4 else np.arange(names.index(name), len(names) - names[::-1].index(name))
        of[name] = tuple(ranges[c].to_numpy()[here] for c in ("range", "first", "start"))
    known = spark.sparkContext.broadcast(of)  # three numbers for each range

    def travel(batches):
        """Each query once for each range that its window touches, however many those are."""
        for batch in batches:
            dim, curve, at = (batch.column(i).to_numpy() for i in range(3))
            for d, c in sorted(set(zip(dim.tolist(), curve.tolist()))):
                number, first, begin = known.value[d, c]
                own = np.flatnonzero((dim == d) & (curve == c))
                r = np.searchsorted(number, at[own] >> 33)
                spot = begin[r] + at[own] - first[r]
                low, high = np.searchsorted(begin, spot - index[d].reach, "right") - 1, np.searchsorted(begin, spot + index[d].reach, "right") - 1
                low = np.maximum(low, 0)
                n = high - low + 1
                row = np.repeat(np.arange(len(own)), n)
                to = low[row] + np.arange(n.sum()) - (np.cumsum(n) - n)[row]
                picked = batch.take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(number[to]), pa.array(spot[row]), picked.column(3), picked.column(4)], names=["dim", "curve", "range", "spot", "pid", "v"])

    def search(rows: pa.Table, asking: pa.Table) -> pa.Table:
        """(query, pid, far): of each query's window, the nearest of this range by codes."""
        found = []
        if rows.num_rows and asking.num_rows:
            rows = rows.sort_by("at")
            d, c, number = (rows[x][0].as_py() for x in ("dim", "curve", "range"))
            own, _, begin = known.value[d, c]
            start, n, width, pid = int(begin[np.searchsorted(own, number)]), rows.num_rows, index[d].reach, rows["pid"].to_numpy()
            x, error = codes.value[d].decoded(rows_of(rows, "code", np.uint8))
            square, center, part = np.einsum("ij,ij->i", x, x), codes.value[d].center, min(1.0, DOUBT / math.sqrt(d))
            for spot, who, q in zip((asking["spot"].to_numpy() - start).tolist(), asking["pid"].to_pylist(), rows_of(asking)):
                a, b = max(0, spot - width), min(n, spot + width + 1)
                q, t = q - center, part * error[a:b]
                far = square[a:b] - 2 * (x[a:b] @ q) + q @ q - error[a:b] ** 2
                root = np.sqrt(t * t + np.maximum(far, 0))
                low, high = (root - t) ** 2, (root + t) ** 2
                if a <= spot < b:
                    far[spot - a] = low[spot - a] = high[spot - a] = np.inf
                best = np.arange(len(far))
                if len(far) > most:  # the nearest, and all that may be as near as the k nearest
                    best = np.flatnonzero((far <= np.partition(far, most - 1)[most - 1]) | (low <= np.partition(high, k - 1)[k - 1]))
                best = best[best != spot - a]
                found.append((np.full(len(best), who), pid[a + best], far[best], low[best], high[best]))
        out = tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * 3)
        return pa.table(list(map(pa.array, out)), names=["query", "pid", "far", "low", "high"])

    sent = laid.where("v is not null").select("dim", "curve", "at", "pid", "v").mapInArrow(lean(travel), "dim long, curve long, range long, spot long, pid long, v binary")
    keys = ["dim", "curve", "range"]
    rows = laid.select(*keys, "at", "pid", "code")
    asking = sent.select(*(F.col(x).alias(f"q_{x}") for x in keys), "spot", F.col("pid").alias("pid"), "v")
    near = rows.groupBy(*keys).cogroup(asking.groupBy(*(f"q_{x}" for x in keys))).applyInArrow(search, "query long, pid long, far double, low double, high double")
    near = near.groupBy("query", "pid").agg(*(F.min(c).alias(c) for c in ("far", "low", "high")))
    by = Window.partitionBy("query")
    near = near.withColumn("n", F.row_number().over(by.orderBy("far", "pid"))).withColumn("m", F.row_number().over(by.orderBy("high", "pid")))
    near = near.withColumn("bound", F.max(F.when(F.col("m") <= k, F.col("high"))).over(by)).where((F.col("n") <= most) | (F.col("low") <= F.col("bound")))
    near = near.select("query", "pid").unionByName(single.where("asks").select(F.col("pid").alias("query"), "pid"))
    met = near.join(single.select("pid", "ids", "v"), "pid")

    def rank(batches):
        """The k+1 nearest ids of a query by the vectors themselves, with its own vector's."""
        for rows in groups(batches, ["query"]):
            x, pid, query = rows_of(rows), rows["pid"].to_numpy(), rows["query"][0].as_py()
            d = x - x[np.flatnonzero(pid == query)[0]]
            score = np.sqrt(np.einsum("ij,ij->i", d, d))
            ids = rows["ids"].combine_chunks()
            n = np.diff(ids.offsets.to_numpy())
            ids, score = ids.flatten().to_numpy(), np.repeat(score, n)
            order = np.lexsort((ids, score))
            _, first = np.unique(ids[order], return_index=True)  # a repeated id counts once, at its nearest
            order = order[np.sort(first)][: k + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), query)), pa.array(ids[order]), pa.array(score[order])], names=["query", "id", "score"])

    ranked = met.repartition(partitions(spark), "query").sortWithinPartitions("query").mapInArrow(lean(rank), "query long, id long, score double")
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))  # k+1 entries
    lists = work.put(lists.join(single.select(F.col("pid").alias("query"), "h1", "h2"), "query").select("h1", "h2", "near"), "lists")
    out = asked.join(lists, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
