"""Tokens of two tokenizers over the same bytes, aligned by pointer jumping.

Every token points to the token that reaches farthest right of those that overlap it; successors are doubled until all stand at the
last token of their component, which names the group. What the corpus says of a pair of ids comes from a join on distinct pairs of
blocks of documents, not on links."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, byte_lengths, lean
from .encoding import encoder, piece_vocabulary

#: Text bytes aligned at once, and text bytes of a block: documents whose distinct pairs are looked up together.
BATCH_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20


class Vocabulary:
    """Bytes and decimal digits of each id."""

    def __init__(self, raw: list[bytes]):
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start, self.raw = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(raw), np.uint8)
        ids = np.arange(len(raw))
        self.n_digits = np.array([len(str(i)) for i in ids.tolist()], np.int64)
        width = len(str(len(raw)))
        self.digits = np.stack([ids // 10 ** np.maximum(self.n_digits - 1 - k, 0) % 10 + ord("0") for k in range(width)], axis=1).astype(np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.raw[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary: its printable alphabet is a rule over the 256 bytes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the others for the signs from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = t.get_added_tokens_decoder()
    return Vocabulary([t.id_to_token(i).encode() if i in special else bytes(byte[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())])


@functools.lru_cache(maxsize=2)
def space_pieces(path: str) -> Vocabulary:
    p, pieces = piece_vocabulary(path)
    return Vocabulary([bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)])


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of B in each token's component, for tokens of A and of B that cover the same bytes, by their ends (ascending)."""
    n = len(ends_a)
    reach_a, reach_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)  # the token of the other side that holds its last byte
    further = ends_a[reach_b] > ends_b if n else np.zeros(0, bool)
    successor = np.concatenate([n + reach_a, np.where(further, reach_b, n + np.arange(len(ends_b)))])
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor[:n] - n, successor[n:] - n
        successor = doubled


def _same_bytes(n_a, a: Vocabulary, ids_a, n_b, b: Vocabulary, ids_b, texts: pa.Array) -> np.ndarray:
    """Whether the bytes of a text's tokens are a space and the text, for A and for B."""
    size = byte_lengths(texts)
    ok = size > 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    for n, vocabulary, ids in ((n_a, a, ids_a), (n_b, b, ids_b)):
        total = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])
        to = np.concatenate([[0], np.cumsum(n)])
        begin, end = total[to[:-1]], total[to[1:]]
        ok &= end - begin == size + 1
        if not ok.any():
            break
        found = vocabulary.bytes_of(ids)
        same = found[np.minimum(begin, max(len(found) - 1, 0))] == ord(" ") if len(found) else np.zeros(len(ok), bool)
        ok &= same
        if ok.all():  # as a rule: everything at once
            rest = np.ones(len(found), bool)
            rest[begin] = False
            if np.array_equal(found[rest], data[offsets[0] : offsets[-1]]):
                continue
        for i in np.flatnonzero(ok).tolist():
            ok[i] = np.array_equal(found[begin[i] + 1 : end[i]], data[offsets[i] : offsets[i + 1]])
    return ok


def _chosen(n: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (n, ids) if keep.all() else (np.where(keep, n, 0), ids[np.repeat(keep, n)])


def _spelled(a: Vocabulary, ids_a, group_a, b: Vocabulary, ids_b, group_b, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text "a1,a2|b1;a3|b2" of all groups in order, and where each document's part ends, its last ";" included. Groups are numbered from 0 over all documents;
    doc_ends: groups up to the end of each."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    at_a = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]  # A's tokens of a group stand before B's
    at_b = np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]
    width = np.empty(len(ids_a) + len(ids_b), np.int64)
    width[at_a], width[at_b] = a.n_digits[ids_a] + 1, b.n_digits[ids_b] + 1
    ends = np.cumsum(width)
    out = np.full(int(ends[-1]) if len(ends) else 0, ord(","), np.uint8)
    for vocabulary, ids, at in ((a, ids_a, at_a), (b, ids_b, at_b)):
        start, n = ends[at] - width[at], vocabulary.n_digits[ids]
        for k in range(vocabulary.digits.shape[1]):
            has = n > k
            out[start[has] + k] = vocabulary.digits[ids[has], k]
    last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
    out[ends[at_a[last_a]] - 1], out[ends[at_b[last_b]] - 1] = ord("|"), ord(";")
    stops = np.concatenate([[0], ends[at_b[last_b]]]) if groups else np.zeros(1, np.int64)
    return out, stops[doc_ends]


def align(texts: pa.Array, path_a: str, path_b: str) -> dict[str, np.ndarray | list]:
    """Alignment of texts (large_string, no null): per text n_a, n_b, n_groups, n_links and groups_sha256; and `links`, a number id_a << 32 | id_b for
    each pair of tokens that end together, in order."""
    import pyarrow.compute as pc

    voc_a, voc_b = byte_level(path_a), space_pieces(path_b)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    n_a, ids_a = encoder(path_a, plain=True).ids(spaced.cast(pa.string()))
    n_b, ids_b = encoder(path_b).ids(texts.cast(pa.string()))
    keep = _same_bytes(n_a, voc_a, ids_a, n_b, voc_b, ids_b, texts)
    (n_a, ids_a), (n_b, ids_b) = _chosen(n_a, ids_a, keep), _chosen(n_b, ids_b, keep)
    ends_a, ends_b = np.cumsum(voc_a.length[ids_a]), np.cumsum(voc_b.length[ids_b])  # over all texts: tokens of two texts never overlap
    last_a, last_b = terminals(ends_a, ends_b)
    closes = np.zeros(len(ids_b), bool)
    closes[last_b] = True
    number = np.cumsum(closes) - 1
    group_a, group_b = number[last_a], number[last_b]
    per_text = np.concatenate([[0], np.cumsum(closes)])[np.concatenate([[0], np.cumsum(n_b)])]
    text, stops = _spelled(voc_a, ids_a, group_a, voc_b, ids_b, group_b, per_text)
    packed, stops = memoryview(text.tobytes()), stops.tolist()
    digests = [hashlib.sha256(packed[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(stops, stops[1:])]
    together = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a if len(ids_a) else np.zeros(0, bool)
    links = ids_a[together].astype(np.int64) << 32 | ids_b[np.searchsorted(ends_b, ends_a[together])]
    n_links = np.diff(np.concatenate([[0], np.cumsum(together)])[np.concatenate([[0], np.cumsum(n_a)])])
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(per_text), "n_links": n_links, "groups_sha256": digests, "links": links}


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, batch_bytes: int, block_bytes: int) -> DataFrame:
    """A row for each document with its block and its links as numbers into the block's distinct pairs, which the first row of the block holds, with
    how often the block has each."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        from pyspark import TaskContext

        held, volume, number = [], 0, 0

        def block():
            flat, at = np.unique(np.concatenate([x["links"] for _, x in held]), return_inverse=True)
            times = np.bincount(at, minlength=len(flat))
            name, done = TaskContext.get().partitionId() << 32 | number, 0
            pairs = pa.StructArray.from_arrays([pa.array(flat >> 32, pa.int32()), pa.array(flat & 0xFFFFFFFF, pa.int32()), pa.array(times)], names=["a", "b", "n"])
            for k, (ids, x) in enumerate(held):
                ends = np.cumsum(x["n_links"])
                links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(at[done : done + len(x["links"])], pa.int32()))
                done += len(x["links"])
                first = np.zeros(len(ids) + 1, np.int32)
                first[1:] = 0 if k else len(pairs)
                of_block = pa.ListArray.from_arrays(pa.array(first), pairs.slice(0, 0) if k else pairs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), name)), *(pa.array(x[c]) for c in _COUNTS), pa.array(x["groups_sha256"], pa.string()), links, of_block], names=["id", "block", *_COUNTS, "groups_sha256", "links", "pairs"])

        for batch in batches:
            sizes = byte_lengths(batch.column(1))
            for i, j in by_bytes(sizes, batch_bytes):
                texts = pa.concat_arrays([batch.column(1).slice(i, j - i).fill_null("").cast(pa.large_string())])
                held.append((batch.column(0).slice(i, j - i), align(texts, path_a, path_b)))
                volume += int(sizes[i:j].sum())
                if volume >= block_bytes:
                    yield from block()
                    held, volume, number = [], 0, number + 1
        if held:
            yield from block()

    schema = f"id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pairs array<struct<a:int,b:int,n:long>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, total, best): links of the whole corpus that hold the pair of ids, and whether no pair has more with this b. At most one row for each pair of
    ids; the join's small side has at most a row for each id of B's vocabulary."""
    total = blocks.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("total"))
    return total.join(F.broadcast(total.groupBy("b").agg(F.max("total").alias("most"))), "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(work: Workspace, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row. A is a byte-level tokenizer file and reads a space before the text, B a piece
    model, which adds one itself.

    A null or empty text, and one whose bytes A's or B's tokens don't spell (a text with a space sign), has zeros and an empty digest. Null and repeated ids have a
    row each; ties of counts are all best; an empty table gives an empty result; other columns are not read. Documents travel by block,
    never by pair: a pair that every block has is counted before the shuffle, and its rows in the join are one for each block, which can be split."""
    blocks = work.put(_aligned_blocks(docs, path_a, path_b, id_col, text_col, batch_bytes, block_bytes), "blocks")
    counts = work.put(pair_counts(blocks), "counts")
    wanted = blocks.select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.a", "p.b")
    known = wanted.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "at", "total", "best")
    kind = dict(docs.dtypes)[id_col]

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        at = found["at"].to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = found["total"].to_numpy(), found["best"].to_numpy()
        links = pa.concat_arrays(rows["links"].chunks)
        flat, offsets = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(rows["n_links"].to_numpy())])
        sums = {"n_best": best, "count_sum": total}
        added = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[flat])])[offsets]).astype(np.int64)) for x in sums.values()]
        return pa.table([rows["id"], *(rows[c] for c in _COUNTS), *added, rows["groups_sha256"]], names=[id_col, *_COUNTS, *sums, "groups_sha256"])

    own = blocks.drop("pairs").groupBy("block").cogroup(known.groupBy("of"))
    return own.applyInArrow(score, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
