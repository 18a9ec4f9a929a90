"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision only where those leave doubt."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, groups, lean, partitions
from .vectors import even, hashed, lengths, rows_of

#: Vectors of a tile at most, of a tile at least if more tiles only serve to occupy all tasks, and of the blocks in which a task multiplies.
TILE, LEAST, BLOCK = 65_536, 1024, 1024
#: Dimensions up to which float32 sums of products of int8 are exact integers: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024


class Codes:
    """Unit vectors u as scale * (q + r / 254) + e, q and r of int8, with |u - scale * q| (`coarse`) and |e| (`fine`)."""

    def __init__(self, q: np.ndarray, r: np.ndarray, scale: np.ndarray, coarse: np.ndarray, fine: np.ndarray):
        self.q, self.r, self.scale, self.coarse, self.fine = q, r, scale, coarse, fine

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        u = even(x)
        u = u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
        scale = np.abs(u).max(axis=1) / 127
        q = np.rint(u / scale[:, None])
        r = np.clip(np.rint((u / scale[:, None] - q) * 254), -127, 127)
        coarse = np.linalg.norm(u - q * scale[:, None], axis=1)
        fine = np.linalg.norm(u - (q + r / 254) * scale[:, None], axis=1)
        return cls(q.astype(np.int8), r.astype(np.int8), scale, coarse, fine)

    def part(self, at) -> Codes:
        return Codes(self.q[at], self.r[at], self.scale[at], self.coarse[at], self.fine[at])

    def products(self, other: Codes) -> np.ndarray:
        out = np.zeros((len(self.q), len(other.q)))
        for c in range(0, self.q.shape[1], EXACT):
            out += self.q[:, c : c + EXACT].astype(np.float32) @ other.q[:, c : c + EXACT].astype(np.float32).T
        return out * (self.scale[:, None] * other.scale[None, :])

    def close(self) -> np.ndarray:
        return (self.q + self.r / 254) * self.scale[:, None]

    def linked(self, other: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs that have a cosine of at least `threshold`, and rows and columns of those in doubt).

        u.v - u'.v' = (u - u').v + u'.(v - v'), and |v| = 1, |u'| <= 1 + |u - u'|: so the error is at most e_u + (1 + e_u) e_v. First with
        the int8 products; pairs that this leaves in doubt with the residuals as well. 1e-9 covers the rounding of doubles."""
        near = self.products(other)
        bound = self.coarse[:, None] + (1 + self.coarse[:, None]) * other.coarse[None, :] + 1e-9
        sure = near - bound >= threshold
        i, j = np.nonzero((near + bound >= threshold) & ~sure)
        doubt = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            a, b = self.part(i[k : k + (1 << 14)]), other.part(j[k : k + (1 << 14)])
            close = np.einsum("ij,ij->i", a.close(), b.close())
            bound = a.fine + (1 + a.fine) * b.fine + 1e-9
            sure[i[k : k + (1 << 14)], j[k : k + (1 << 14)]] = close - bound >= threshold
            doubt[k : k + (1 << 14)] = (close + bound >= threshold) & (close - bound < threshold)
        return sure, i[doubt], j[doubt]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision."""
    x, y = even(x), even(y)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def least_labels(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (id, smaller id) that keep connected what a block's links connect: one for each row and column at most."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return []
    part, top = linked[np.ix_(rows, cols)], np.iinfo(np.int64).max
    la, lb = a[rows], b[cols]
    while True:
        na = np.minimum(la, np.where(part, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(part, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return [(a[rows], la), (b[cols], lb)]


def _coded(batches):
    """(id, copies, dim, q, r, scale, coarse, fine) of vectors."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        dim = t["dim"].to_numpy()
        for d in np.unique(dim).tolist():
            part = t.filter(pa.array(dim == d))
            c = Codes.of(rows_of(part))
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), part["copies"].combine_chunks(), part["dim"].combine_chunks(), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (c.q, c.r)), *map(pa.array, (c.scale, c.coarse, c.fine))], names=["id", "copies", "dim", "q", "r", "scale", "coarse", "fine"])


def cosine_classes(work: Workspace, df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE, least: int = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold a null or non-finite component have no links and stay; so do rows without an id, whose
    component_id is null. Vectors of different lengths don't link. Repeated rows and ids count as a vector each. An empty table gives
    an empty result; other columns are not read.

    Equal vectors are compared as one and counted as many. Every pair of tiles is one unit of work of bounded size, and only int8 codes with
    their scales and error norms travel to it. It returns counts and at most one edge for each vector of a block; pairs leave it only
    where two int8 levels can't tell on which side of the threshold they lie (a band of about 1e-4), and only for these the doubles are fetched."""
    spark = df.sparkSession
    n_parts = partitions(spark)
    points = work.put(hashed(df, id_col, vec_col), "points")
    good = points.where("dim is not null")
    copies = good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    # written numbers for the distinct vectors, since several may have one id
    copies = work.put(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    single = copies.select(F.col("node").alias("id"), "copies", "dim", "v")
    codes = work.put(single.mapInArrow(lean(_coded), "id long, copies long, dim long, q binary, r binary, scale double, coarse double, fine double"), "codes")
    counts = lengths(codes)
    tiles = {d: max(1, -(-n // tile), min(-(-n // least), math.ceil(math.sqrt(2 * n_parts)))) for d, n in counts.items()}
    n_tiles = F.element_at(F.create_map(*(F.lit(x) for kv in tiles.items() for x in kv)), F.col("dim")) if tiles else F.lit(1)
    units = F.transform(F.sequence(F.lit(0), n_tiles.cast("int") - 1), lambda j: F.struct(F.least("tile", j).alias("t1"), F.greatest("tile", j).alias("t2")))
    spread = codes.withColumn("tile", F.pmod(F.xxhash64("id"), n_tiles.cast("int")).cast("int")).select("*", F.explode(units).alias("u")).select("dim", "u.t1", "u.t2", "tile", "id", "copies", "q", "r", "scale", "coarse", "fine")
    keys = ["dim", "t1", "t2"]

    def meet(batches):
        for rows in groups(batches, keys):
            tile_of, ids, copies = rows["tile"].to_numpy(), rows["id"].to_numpy(), rows["copies"].to_numpy()
            every = Codes(rows_of(rows, "q", np.int8), rows_of(rows, "r", np.int8), *(rows[c].to_numpy() for c in ("scale", "coarse", "fine")))
            t1, t2 = rows["t1"][0].as_py(), rows["t2"][0].as_py()
            sides = [np.flatnonzero(tile_of == t) for t in dict.fromkeys((t1, t2))]
            held = [(ids[s], copies[s], every.part(s)) for s in sides]
            (ia, ca, qa), (ib, cb, qb) = held[0], held[-1]
            na, nb, edges, doubt = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), [], []
            for p in range(0, len(ia), BLOCK):
                a = slice(p, p + BLOCK)
                for r in range(p if t1 == t2 else 0, len(ib), BLOCK):
                    b = slice(r, r + BLOCK)
                    linked, i, j = qa.part(a).linked(qb.part(b), threshold)
                    if t1 == t2 and p == r:
                        linked = np.triu(linked, 1)
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        doubt.append((ia[a][i], ib[b][j]))
                    if linked.any():
                        na[a] += linked @ cb[b]
                        nb[b] += ca[a] @ linked
                        edges += least_labels(linked, ia[a], ib[b])
            pairs = np.unique(np.concatenate([np.stack(e, 1) for e in edges]), axis=0) if edges else np.zeros((0, 2), np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            n, of = np.concatenate([na, nb]), np.concatenate([ia, ib])
            at = np.flatnonzero(n)
            unsure = [np.concatenate(x) for x in zip(*doubt)] if doubt else [np.zeros(0, np.int64)] * 2
            # one stream of rows: (id, other, 0) is an edge, (id, id, n) a count of links, (id, other, -1) a pair in doubt
            out = (np.concatenate([pairs[:, 0], of[at], unsure[0]]), np.concatenate([pairs[:, 1], of[at], unsure[1]]), np.concatenate([np.zeros(len(pairs), np.int64), n[at], np.full(len(unsure[0]), -1)]))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["a", "b", "n"])

    def decide(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dim = t["dim"].to_numpy()
            for d in np.unique(dim).tolist():
                part = t.filter(pa.array(dim == d))
                part = part.filter(pa.array(cosines(rows_of(part, "x"), rows_of(part, "y")) >= threshold))
                yield from part.select(["a", "b", "ca", "cb"]).combine_chunks().to_batches()

    n_units = sum(t * (t + 1) // 2 for t in tiles.values())
    units_of = spread.repartition(max(n_parts, min(n_units, 4 * n_parts)), *keys).sortWithinPartitions(*keys)
    found = work.put(units_of.mapInArrow(lean(meet), "a long, b long, n long"), "found")
    whole = lambda k, v: single.select(F.col("id").alias(k), F.col("v").alias(v), "dim" if k == "a" else F.col("dim").alias("_dim"), F.col("copies").alias(f"c{k}"))
    unsure = found.where("n = -1").select("a", "b").join(whole("a", "x"), "a").join(whole("b", "y"), "b").where("dim = _dim")
    decided = work.put(unsure.select("a", "b", "dim", "x", "y", "ca", "cb").mapInArrow(decide, "a long, b long, ca long, cb long"), "decided")
    links = found.where("n > 0").select("a", "n").unionByName(decided.select("a", F.col("cb").alias("n"))).unionByName(decided.select(F.col("b").alias("a"), F.col("ca").alias("n")))
    links = links.groupBy("a").agg(F.sum("n").alias("n"))
    classes = components(work, found.where("n = 0").select("a", "b").unionByName(decided.select("a", "b")), "class").withColumnRenamed("id", "node")
    least_id = classes.join(copies.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(work.put(least_id, "least"), "component").select("node", "component_id")
    rep = copies.select("h1", "h2", "node", "rep", "copies").join(links.withColumnRenamed("a", "node"), "node", "left").join(classes, "node", "left")
    # written, so that both sides of the last join are plain shuffles and a vector copied everywhere can be split
    rep = work.put(rep.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "classes")
    linked = good.select(F.col("id").alias("vec_id"), "h1", "h2").join(rep, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = points.where("dim is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
