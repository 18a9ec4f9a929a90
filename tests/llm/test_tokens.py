import zlib

import numpy as np
import pytest

from vigil.llm import queries as Q
from vigil.llm.binary_records import frame, token_records, unframe, write_records
from vigil.llm.common import Workspace
from vigil.llm.packing import pack, pack_documents
from vigil.llm.token_counts import token_counts

from .helpers import odd_documents

SCHEMA = "doc_id long, text string, shard string, offset long"  # extra columns whose names clash with the operators' own


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in odd_documents()], SCHEMA)


def hf(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    return [np.array([*x.ids, 2], "<u4") for x in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark, docs):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts(docs, Q.tokenizer("piece_bpe_32k.model"), batch_bytes=100).collect()}
    for i, t in odd_documents():
        n = len(p.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), (i, t and t[:40])
    assert token_counts(docs.limit(0), Q.tokenizer("piece_bpe_32k.model")).count() == 0


def test_records_round_trip(spark, docs):
    got = {r.doc_id: r for r in token_records(Workspace(spark), docs, Q.tokenizer("byte_bpe_50k.json")).collect()}
    start = 0
    for (i, _), ids in zip(odd_documents(), hf([t for _, t in odd_documents()])):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    assert token_records(Workspace(spark), docs.limit(0), Q.tokenizer("byte_bpe_50k.json")).count() == 0


def test_record_frames():
    for key, ids, width in ((5, [1, 2, 50256], 2), (None, [2], 2), (-3, [], 4)):
        k, x = unframe(frame(key, np.array(ids, np.int64), width))
        assert (k, x.tolist()) == (key, ids)
    broken = bytearray(frame(5, np.array([1, 2]), 2))
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        unframe(bytes(broken))


def test_packing_is_gapless_and_whole(spark, docs):
    size = 64
    rows = pack_documents(Workspace(spark), docs, Q.tokenizer("byte_bpe_50k.json"), size=size, shard_pieces=500).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (i, _), ids in zip(odd_documents(), hf([t for _, t in odd_documents()])):
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == size or k == 0
            at += r.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert pack_documents(Workspace(spark), docs.limit(0), Q.tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_needs_few_bins():
    lengths = np.random.default_rng(1).integers(1, 1025, 20_000)
    where, offset = pack(lengths, 1024)
    assert np.bincount(where, lengths).max() <= 1024
    assert where.max() + 1 <= 1.01 * lengths.sum() / 1024 + 1


def plain_pack(lengths, size):
    """Straight from the definition: bins as a list; the sum of squares is computed anew for every choice."""
    bins, where, offset = [], {}, {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        gaps = lambda: np.bincount([g for g in bins if g], minlength=size + 1)
        choices = {}
        for gap in {g for g in bins if g >= lengths[i]}:
            n = gaps()
            n[gap] -= 1
            n[gap - lengths[i]] += gap > lengths[i]
            choices[gap] = (int((n**2).sum()), gap)
        gap = min(choices, key=choices.get) if choices else size
        b = max((k for k, g in enumerate(bins) if g == gap), default=None) if choices else len(bins)
        if not choices:
            bins.append(size)
        where[i], offset[i] = b, size - gap
        bins[b] = gap - lengths[i]
    return sorted(bins), [size - offset[i] for i in range(len(lengths))]


def test_packing_follows_the_sums_of_squares():
    for seed in range(4):
        r = np.random.default_rng(seed)
        lengths = r.integers(1, 33, 150) if seed % 2 else r.choice([5, 5, 9, 32, 1, 16], 150)
        where, offset = pack(lengths, 32)
        fill = np.bincount(where, lengths)
        bins, gaps = plain_pack(lengths.tolist(), 32)
        assert sorted((32 - fill).astype(int).tolist()) == bins
        assert (32 - offset).tolist() == gaps  # the gap that each piece met


def test_repeated_and_null_ids_have_records_each(spark):
    rows = [(None, "x y"), (None, None), (3, "b"), (3, "a a a"), (3, "b"), (1, "z")]
    got = token_records(Workspace(spark), spark.createDataFrame(rows, "doc_id long, text string"), Q.tokenizer("byte_bpe_50k.json")).collect()
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, hf([t for _, t in rows])))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at, places = 0, sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    for start, n, _ in places:
        assert start == at
        at += n
    ids = [i for *_, i in places]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_many_equal_rows_go_to_many_files(spark):
    df = spark.createDataFrame([(7, "the same text")] * 3000 + [(i, f"t {i}") for i in range(100)], "doc_id long, text string")
    work = Workspace(spark)
    got = token_records(work, df, Q.tokenizer("byte_bpe_50k.json")).collect()
    places = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    per_file = [r["count"] for r in spark.read.parquet(work.path("index")).groupBy("shard").count().collect()]
    assert max(per_file) < 2 * 3100 / 4


def test_narrow_ids_are_an_error(spark, tmp_path, docs):
    with pytest.raises(Exception, match="don't fit into 1 bytes"):
        write_records(docs, Q.tokenizer("byte_bpe_50k.json"), f"file://{tmp_path}", id_width=1).collect()


def test_memory_of_stretches_is_bounded(monkeypatch):
    import pyarrow as pa

    from vigil.llm import encoding

    monkeypatch.setattr(encoding, "MEMO", 50)
    monkeypatch.setattr(encoding, "MOST_IDS", 400)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        encoding.encoder.cache_clear()
        memory = encoding.encoder(Q.tokenizer(name))
        fresh = encoding.Stretches(memory.odd, memory.cut, memory.marks_first, memory.encode, memory.vocabulary)
        texts = [t for _, t in odd_documents() if t is None or len(t) < 5000]
        for t in texts * 2:
            n, ids = memory.ids(pa.array([t, "the a\u00a0 b\u00a0c \u00a0d", t], pa.string()))
            fresh.forget(np.zeros(0, np.int64))
            m, alone = fresh.ids(pa.array([t], pa.string()))
            assert n[0] == n[2] == m[0] and ids[: n[0]].tolist() == alone.tolist()
            assert len(memory.known) <= 2000
    encoding.encoder.cache_clear()
