"""Best-fit packing of token sequences by the sum of squares of open bins per residual gap."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_records import with_end
from .common import Workspace, by_bytes, byte_lengths, groups, lean, partitions
from .encoding import encoder
from .token_counts import BATCH_BYTES

#: Pieces packed by one task on average. More pack tighter, and take longer.
SHARD_PIECES = 20_000


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, longest first, all of length 1 to `size`.

    A piece goes to the open bin after which the sum over gaps of (open bins with that gap) squared is smallest; of equal sums
    the tightest. A new bin opens only where no open one has room, which keeps bins few."""
    order = np.argsort(-lengths, kind="stable")
    n_open = np.zeros(size + 1, np.int64)  # gap 0: closed, counts nothing
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in order.tolist():
        s = int(lengths[i])
        have = n_open[s:size]
        fits = np.flatnonzero(have)
        if len(fits):
            after = n_open[fits]  # bins that have the gap which this bin would get
            change = np.where(fits == 0, 1 - 2 * have[fits], 2 * (after - have[fits]) + 2)
            gap = s + int(fits[np.argmin(change)])
            b = bins[gap].pop()
            n_open[gap] -= 1
        else:
            gap, b, used = size, used, used + 1
        where[i], offset[i] = b, size - gap
        if gap > s:
            bins[gap - s].append(b)
            n_open[gap - s] += 1
    return where, offset


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the end id, in pieces of at most `size`. Only the first
    piece of a longer document is shorter than `size`. A null text counts as empty; repeated rows give pieces each."""

    def run(batches):
        memory = encoder(tokenizer)
        for batch in batches:
            for a, b in by_bytes(byte_lengths(batch.column(1)), BATCH_BYTES):
                lengths, flat = memory.ids(batch.column(1).slice(a, b - a))
                ids, ends = with_end(lengths, flat, end_id, "<u4")
                lengths = lengths + 1
                n = -(-lengths // size)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                head = np.repeat(lengths - (n - 1) * size, n)  # ids of the first piece
                start, long = np.where(piece == 0, 0, head + (piece - 1) * size), np.where(piece == 0, head, size)
                at, raw = (np.repeat(ends - lengths, n) + start) * 4, memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * long).tolist())]
                keys = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(long), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(work: Workspace, docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in a sequence of at most `size` ids,
    gapless from offset 0. Texts are encoded once and only lengths move: pieces are dealt by a hash into shards of
    about `shard_pieces`, so neither a source nor a group of copies weighs on one task. An empty table gives an empty result."""
    spark = docs.sparkSession
    pieces = work.put(token_pieces(docs, tokenizer, size, end_id), "pieces")
    shards = max(1, -(-pieces.where(F.col("length") < size).count() // shard_pieces))
    short = pieces.where(F.col("length") < size).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def run(batches):
        for rows in groups(batches, ["shard"]):
            where, offset = pack(rows["length"].to_numpy(), size)
            out = rows.append_column("sequence_id", pa.array((where << 24) | rows["shard"][0].as_py())).append_column("offset", pa.array(offset))
            yield from out.drop_columns(["shard"]).combine_chunks().to_batches()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "shard"]
    packed = short.select(columns).repartition(max(1, min(shards, 4 * partitions(spark))), "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece").mapInArrow(lean(run), kinds)
    whole = pieces.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
