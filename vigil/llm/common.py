"""Shared pieces of the training-data operators: tables, written stages, grouped Arrow streams, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, so that tasks import it wherever the driver found it. Once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_vigil_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="vigil-")) / "vigil_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._vigil_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one in local mode only, as in tests:
    elsewhere executors would write to their own disks."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_vigil_shared", None):
        sc._vigil_shared = "file://" + tempfile.mkdtemp(prefix="spark-vigil-")
    return sc._vigil_shared


class Workspace:
    """Written tables of one query in the shared folder. They cut lineage, outlive lost executors, and
    can be dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        ship_code(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/vigil-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library
        return lambda pad: 0


def lean(run):
    """A function over Arrow batches that gives its freed memory back to the system when a task ends: workers are kept for later
    stages, and what one stage needed at most would otherwise stay with each of them."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return task


def by_bytes(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows of about `limit` bytes in all; a longer row is a run by itself."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def strings(column: pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal integer keys in a sorted stream. Holds one group at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = np.stack([t[c].to_numpy() for c in keys], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist(), len(k)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(k[a].tolist())
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each row reaches."""
    n = len(linked)
    root = np.full(n, -1, dtype=np.int64)
    for i in range(n):
        if root[i] >= 0:
            continue
        seen = np.zeros(n, dtype=bool)
        front = np.array([i])
        seen[i] = True
        while len(front):
            new = linked[front].any(axis=0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        root[seen] = i
    return root


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class IdFilter:
    """A bitmap of hashed ids of fixed size (2 MB): tells which rows may have one of some ids, so that only those are shuffled to a
    join. It never misses an id; beyond some ten million ids it spares less, and the join decides in any case."""

    BITS = 1 << 24

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @staticmethod
    def places(ids: np.ndarray) -> np.ndarray:
        return (mix64(ids.astype(np.uint64)) & np.uint64(IdFilter.BITS - 1)).astype(np.int64)

    @classmethod
    def of(cls, ids: DataFrame) -> IdFilter:
        """From a DataFrame of doc_id; at most BITS / 64 words reach the driver, however many ids there are."""

        def run(batches):
            bits = np.zeros(cls.BITS, bool)
            for batch in batches:
                bits[cls.places(batch.column(0).to_numpy())] = True
            words = np.packbits(bits, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

        found = ids.select("doc_id").coalesce(16).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(cls.BITS // 64, np.int64)
        words[found["at"].to_numpy()] = found["word"].to_numpy()
        return cls(ids.sparkSession.sparkContext.broadcast(words.view(np.uint8)))

    def hits(self, ids: pa.Array) -> np.ndarray:
        at = self.places(ids.fill_null(-1).to_numpy(zero_copy_only=False))
        return (self.broadcast.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def column(self, doc_id):
        """The same as a column over a bigint column: only ids go to Python."""
        @F.pandas_udf("boolean")
        def hit(ids: pd.Series) -> pd.Series:
            return pd.Series(self.hits(pa.array(ids.fillna(-1).astype("int64"))))

        return hit(doc_id)


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component) for every id that an edge joins to
    another, component being the smallest id reachable, itself included.

    Alternating large-star and small-star steps: every step is an aggregate and a join over the edges, which never
    grow in number, and the number of rounds is logarithmic. Each round is written to the shared folder, and so are the
    smallest neighbours before the first join, which leaves both its sides plain shuffles: adaptive execution can split a hub's."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = work.put(e, f"{name}-0")
    before = None
    for turn in range(1, 64):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low-{turn}")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = work.put(small.select("x.a", "x.b").where("a <> b").distinct(), f"{name}-{turn}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{turn - 1}")
        work.drop(f"{name}-low-{turn}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components are not stable after 63 rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
