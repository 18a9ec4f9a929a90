"""Vectors of array columns as matrices, equal vectors as one, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each length from which an index's scale is read, about: those of least hash of the id.
SAMPLE = 10_000


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision) for each length of the usable vectors of a list column. Unusable: null, empty, zero,
    or with a null or non-finite component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == dim)
        x = values[offsets[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield rows[ok], x[ok] + 0.0  # one zero


def hashed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, h1, h2, v) for every row: usable vectors as bytes of doubles, with their length and a 128-bit hash that equal vectors share;
    of other rows, and of those without an id, only the id."""
    import xxhash

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            dim, h, raw = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.full(n, None, object)
            for rows, x in matrices(batch.column(1)):
                dim[rows] = x.shape[1]
                for i, r in zip(rows.tolist(), x):
                    raw[i] = r.tobytes()
                    h[i] = np.frombuffer(xxhash.xxh3_128_digest(raw[i]), np.int64)
            none = (dim == 0) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64(), mask=none) for c in (dim, h[:, 0], h[:, 1])), pa.array(np.where(none, None, raw), pa.binary())], names=["id", "dim", "h1", "h2", "v"])

    kinds = "id long, dim long, h1 long, h2 long, v binary"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).mapInArrow(run, kinds)


def lengths(points: DataFrame) -> dict[int, int]:
    """Number of vectors of each length; a table has one, or a few."""
    return {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}


def sample(points: DataFrame, counts: dict[int, int], most: int = SAMPLE) -> dict[int, np.ndarray]:
    """About `most` vectors of each length, in an order that reruns repeat: those whose hashed id lies below a mark that the numbers of rows give."""
    lot = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 32))
    share = F.element_at(F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, int(min(1.0, most / n) * (1 << 32))))), F.col("dim")) if counts else F.lit(0)
    rows = points.where(lot <= share).select("dim", lot.alias("lot"), "id", "v").toArrow().sort_by([("lot", "ascending"), ("id", "ascending")])
    dim = rows["dim"].to_numpy()
    return {d: rows_of(rows.filter(pa.array(dim == d))) for d in counts}


def rows_of(table: pa.Table, name: str = "v", kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), kind)


def even(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, which rounds nothing, so that the largest component is about 1 and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
