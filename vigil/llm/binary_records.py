"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record: length of its payload (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload (4).
A payload: one byte (bytes per id, plus 128 for a null document id), the document id (8), the ids (2 or 4 bytes each, as the
vocabulary needs). All numbers are little-endian. One file per range of document ids, named by its place in the order."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, byte_lengths, groups, lean, partitions
from .encoding import encoder
from .token_counts import BATCH_BYTES

_HEAD, _OPEN, _CRC = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<I")


def turned(c: int) -> int:
    """A CRC-32 turned and shifted, so that checksums of data that hold checksums stay telling."""
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def masked(data: bytes) -> int:
    return turned(zlib.crc32(data))


def with_end(lengths: np.ndarray, flat: np.ndarray, end_id: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids and the end id, in one buffer, and where each text ends there."""
    ends = np.cumsum(lengths + 1)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, kind)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    ids[last], ids[~last] = end_id, flat
    return ids, ends


def framed(doc_id: int | None, ids: memoryview, width: int) -> tuple[bytes, ...]:
    """The parts of a record, from ids as bytes."""
    opened = _OPEN.pack(width | (128 if doc_id is None else 0), doc_id or 0)
    size = struct.pack("<Q", len(opened) + len(ids))
    return size, _CRC.pack(masked(size)), opened, ids, _CRC.pack(turned(zlib.crc32(ids, zlib.crc32(opened))))


def frame_bytes() -> int:
    """Bytes of a record besides its ids."""
    return _HEAD.size + _OPEN.size + _CRC.size


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return b"".join(framed(doc_id, memoryview(ids.astype(f"<u{width}").tobytes()), width))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one whole record. ValueError if a checksum or length is wrong."""
    size, check = _HEAD.unpack_from(record)
    payload = record[_HEAD.size : -_CRC.size]
    if masked(record[:8]) != check or size != len(payload) or masked(payload) != _CRC.unpack(record[-_CRC.size :])[0]:
        raise ValueError("a record is damaged")
    kind, doc_id = _OPEN.unpack_from(payload)
    return None if kind & 128 else doc_id, np.frombuffer(payload, f"<u{kind & 127}", offset=_OPEN.size)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def file_name(shard: int) -> str:
    return f"part-{shard:06d}.records"


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every row's ids and the end id to `folder`, which executors share, in ascending id order (null first, equal ids
    by a hash of their text, so that the rows of one id may lie in several files). Lazy: returns the index (shard, record, doc_id,
    offset, length, n_tokens), which must be stored once.

    Ids take 2 bytes if the vocabulary and the end id allow it, else 4; a narrower `id_width` is an error. Null and empty texts give a record with the end id alone; repeated rows give a record each; an empty table gives
    no file. Files appear under their name only when complete, and a repeated task writes the same bytes again."""
    spark = docs.sparkSession

    def run(batches):
        memory = encoder(tokenizer)
        needed = 2 if max(memory.vocabulary - 1, end_id) < 1 << 16 else 4
        width = id_width or needed
        if width < needed:
            raise ValueError(f"ids of {tokenizer} don't fit into {width} bytes")
        shard = TaskContext.get().partitionId()
        files, at = _filesystem(folder)
        out, part, place, record = None, f"{at}/.{file_name(shard)}.{TaskContext.get().taskAttemptId()}", 0, 0
        for batch in batches:
            for a, b in by_bytes(byte_lengths(batch.column(1)), BATCH_BYTES):
                if out is None:
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(part)
                lengths, flat = memory.ids(batch.column(1).slice(a, b - a))
                ids, ends = with_end(lengths, flat, end_id, f"<u{width}")
                keys, raw, cuts = batch.column(0).slice(a, b - a), memoryview(ids).cast("B"), [0, *(ends * width).tolist()]
                out.write(b"".join(x for k, i, j in zip(keys.to_pylist(), cuts, cuts[1:]) for x in framed(k, raw[i:j], width)))
                n, size = len(ends), (lengths + 1) * width + frame_bytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(record, record + n)), keys, pa.array(place + np.cumsum(size) - size), pa.array(size), pa.array(lengths + 1)], names=["shard", "record", "doc_id", "offset", "length", "n_tokens"])
                place, record = place + int(size.sum()), record + n
        if out is not None:
            out.close()
            files.move(part, f"{at}/{file_name(shard)}")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("lot"), F.monotonically_increasing_id().alias("row")).repartitionByRange(partitions(spark), "doc_id", "lot", "row")
    rows = rows.sortWithinPartitions("doc_id", "lot", "text", "row").select("doc_id", "text")
    return rows.mapInArrow(lean(run), "shard long, record long, doc_id long, offset long, length long, n_tokens long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(shard, record, doc_id, n_tokens, ids_crc32, before) of every record that the index lists, from the files: `before` counts
    the ids of earlier records of the file. Verifies all checksums. Rows of one file go to one task in order; a shuffled read would
    deal the index rows out otherwise, since each record is found by its offset."""

    def run(batches):
        files, at = _filesystem(folder)
        for rows in groups_within(batches):
            shard, start = rows["shard"][0].as_py(), rows.pop("before")
            with files.open_input_file(f"{at}/{file_name(shard)}") as f:
                a = rows["offset"][0].as_py()
                b = rows["offset"][-1].as_py() + rows["length"][-1].as_py()
                block, found = f.read_at(b - a, a), []
                for place, size in zip(rows["offset"].to_pylist(), rows["length"].to_pylist()):
                    doc_id, ids = unframe(block[place - a : place - a + size])
                    found.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            n = np.array([x[1] for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), rows["record"], pa.array([x[0] for x in found], pa.int64()), pa.array(n), pa.array([x[2] for x in found], pa.int64()), pa.array(start + np.cumsum(n) - n)], names=["shard", "record", "doc_id", "n_tokens", "ids_crc32", "before"])

    def groups_within(batches):
        """Rows of one file and of a few MB at a time, with the ids of the file before them."""
        last, before = None, 0
        for batch in batches:
            for rows in groups([batch], ["shard"]):
                shard = rows["shard"][0].as_py()
                if shard != last:
                    last, before = shard, 0
                for a, b in by_bytes(rows["length"].to_numpy(), 8 * BATCH_BYTES):
                    part = rows.slice(a, b - a).combine_chunks()
                    yield {c: part[c].chunk(0) for c in part.column_names} | {"before": before}
                    before += int(part["n_tokens"].to_numpy().sum())

    rows = index.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "record")
    return rows.mapInArrow(run, "shard long, record long, doc_id long, n_tokens long, ids_crc32 long, before long")


def token_records(work: Workspace, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents, read them back: (doc_id, start, n_tokens, ids_crc32), start counting the ids of all documents before.
    The totals per file are one row for each file, summed in a window of that many rows."""
    folder = work.path("records")
    index = work.put(write_records(docs, tokenizer, folder, end_id), "index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    found = read_records(index, folder)
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
