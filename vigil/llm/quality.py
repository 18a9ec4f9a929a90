"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole documents.

Each byte has a learned vector; learned filters slide over the bytes of a chunk; the largest response of each filter in a chunk is
kept, these are averaged over the document's chunks, and a logistic unit makes one probability of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, byte_lengths, lean, ship_code

#: Bytes of a chunk and of the stretch that neighbours share; bytes under a filter, step of filters, size of a byte's vector, filters.
CHUNK, OVERLAP, WIDTH, STEP, BYTE_DIM, FILTERS = 512, 64, 8, 4, 8, 32
#: Labelled documents that training takes at most, and their bytes in all: whole texts by hash of the id, those left out that no longer fit. Chunks of a document in a training step; passes.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_CHUNKS, EPOCHS = 3000, 48 << 20, 4, 14
PAD = 256
#: Documents with this remainder of crc32(doc_id as text) mod 4 are held out.
HELD_OUT = 2


@dataclass
class Network:
    vectors: np.ndarray  # (257, BYTE_DIM); the last is padding
    filters: np.ndarray  # (WIDTH * BYTE_DIM, FILTERS)
    shift: np.ndarray
    weight: np.ndarray
    bias: float

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        x = self.vectors[chunks]
        n, length, dim = x.shape
        s = x.strides
        steps = (length - WIDTH) // STEP + 1
        view = np.lib.stride_tricks.as_strided(x, (n, steps, WIDTH, dim), (s[0], STEP * s[1], s[1], s[2]))
        return view.reshape(n, steps, WIDTH * dim)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), 64):
            out[a : a + 64] = (self.windows(chunks[a : a + 64]) @ self.filters).max(axis=1)
        return np.maximum(out + self.shift, 0)

    def scores(self, chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each document, whose chunks follow one another."""
        mean = np.add.reduceat(self.pooled(chunks).astype(np.float64), np.concatenate([[0], np.cumsum(counts)[:-1]])) / counts[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.weight + self.bias, -30, 30)))


def chunks_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that cover each stretch of some bytes, and how many each has. An empty stretch has one of padding."""
    hop = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(ends - starts - OVERLAP) // hop))
    first = np.repeat(starts, counts) + hop * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    at = first[:, None] + np.arange(CHUNK)
    inside = at < np.repeat(ends, counts)[:, None]
    if not len(data):
        return np.full(at.shape, PAD, np.int16), counts
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), PAD), counts


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def train(chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Fit by Adam on random chunks of documents, whose chunks follow one another. Without rows of both classes every score is the share of label 1 (a half without rows)."""
    r = np.random.default_rng(seed)
    net = Network(r.normal(0, 0.5, (257, BYTE_DIM)).astype(np.float32), r.normal(0, 0.15, (WIDTH * BYTE_DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0.0)
    net.vectors[PAD] = 0
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return net
    net.weight = r.normal(0, 0.1, FILTERS)
    first = np.cumsum(counts) - counts
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("vectors", "filters", "shift", "weight")} | {"bias": [0.0, 0.0]}
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        order = r.permutation(len(labels))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            pick = first[rows][:, None] + r.integers(0, 1 << 30, (len(rows), TRAIN_CHUNKS)) % counts[rows][:, None]
            x = chunks[pick.ravel()]
            w = net.windows(x)
            z = w @ net.filters
            top = z.argmax(axis=1)
            p = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + net.shift
            act = np.maximum(p, 0)
            doc = act.reshape(len(rows), TRAIN_CHUNKS, FILTERS).mean(axis=1)
            y = 1 / (1 + np.exp(-np.clip(doc @ net.weight + net.bias, -30, 30)))
            g = (y - labels[rows]) / len(rows)
            grad = {"weight": doc.T @ g + 1e-4 * net.weight, "bias": float(g.sum())}
            d = np.repeat(g[:, None] * net.weight[None, :] / TRAIN_CHUNKS, TRAIN_CHUNKS, axis=0) * (p > 0)
            best = np.take_along_axis(w, top[:, :, None], 1)  # (chunk, filter, window)
            grad["filters"] = np.einsum("cfw,cf->wf", best, d)
            grad["shift"] = d.sum(axis=0)
            dw = d[:, :, None] * net.filters.T[None]  # (chunk, filter, window)
            at = top[:, :, None] * STEP + np.arange(WIDTH)[None, None, :]
            which = np.take_along_axis(x, at.reshape(len(x), -1), 1).ravel()
            dv = dw.reshape(-1, BYTE_DIM)
            grad["vectors"] = np.stack([np.bincount(which, dv[:, i], 257) for i in range(BYTE_DIM)], 1)
            grad["vectors"][PAD] = 0
            t += 1
            for k, gr in grad.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * gr, 0.99 * v + 0.01 * gr * gr
                state[k] = [m, v]
                step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                setattr(net, k, getattr(net, k) - (step.astype(np.float32) if k in ("vectors", "filters", "shift") else step))
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def training(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, chunks of each document, labels) of whole texts of labelled rows that aren't held out: a bounded sample, by hash of the id, at most `most` rows
    of `most_bytes` in all. A text for which no room is left is passed over, so that one very long text doesn't end the sample. Rows without an id or a label
    don't count; repeated rows count once, different texts of an id each."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label"))
    chosen = chosen.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_id", "_label", F.xxhash64("text").alias("_t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_n"), "text")
    order, room, fits = ["_id", "_label", "_t"], most_bytes, []
    for r in rows.select(*order, "_n").distinct().orderBy(F.xxhash64("_id"), *order).limit(most).collect():
        if r["_n"] <= room:
            fits.append(tuple(r[c] for c in order))
            room -= r["_n"]
    keys = docs.sparkSession.createDataFrame(fits, "_id long, _label int, _t long")
    rows = rows.join(F.broadcast(keys), order, "left_semi").dropDuplicates(order).select("_id", "_label", "text").toArrow()
    rows = rows.sort_by([("_id", "ascending"), ("_label", "ascending"), ("text", "ascending")])
    chunks, counts = chunks_of(*_joined([(x or "").encode("utf-8", "surrogatepass") for x in rows["text"].to_pylist()]))
    return chunks, counts, rows["_label"].to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Network:
    """Train on a bounded sample of the labelled documents."""
    return train(*training(docs, labels, most))


def _scores(net: Network, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for a, b in by_bytes(byte_lengths(column), 1 << 19):
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in column.slice(a, b - a).to_pylist()]
        chunks, counts = chunks_of(*_joined(texts))
        out[a:b] = net.scores(chunks, counts)
    return out


def score_quality(docs: DataFrame, net: Network, good: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its whole text alone; null and empty texts are scored as padding.
    One narrow stage; an empty table gives an empty result."""
    ship_code(docs.sparkSession)

    def run(batches):
        for batch in batches:
            s = _scores(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= good).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, good: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches `good`."""
    ship_code(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(net, batch.column(at)) >= good))

    return docs.mapInArrow(lean(run), docs.schema)
