"""Exact Jaccard join of documents on word n-grams, by blocked sparse products of document and n-gram incidence.

1. Each text gives its set of n-grams (64-bit hashes) and tokens: the hash space is dealt into K parts, and a part's elements
   give one token. Two sets of n and m elements that reach the threshold t differ in at most D = (1-t)/(1+t) * (n+m) elements, so
   at most D tokens of either are missing in the other: the first token that both have, in whatever order of all tokens, is among the first
   D+1 of each. Small sets have their elements as tokens instead.
2. The order is from rare to frequent, counted over the corpus. So passages that many documents share bring nobody together unless
   they make up most of them. Tokens of one set alone can't be shared; they only take up places among the D+1.
3. Sets that share a chosen token fall into one cluster; inside it, blocks of documents of compatible sizes meet once. The product of
   their incidence gives the overlaps, pairs below the bound go, and a spanning forest of the links that remain is kept, never all pairs.
4. Components of those links give the classes of sets; documents find theirs by the hash of their set. Equal sets never become edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IdFilter, Workspace, components, forest, groups, lean, mix64, partitions, strings

#: Sets below this size have single elements as tokens.
SMALL = 64
#: Documents in a block of a large cluster.
BLOCK = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; of its whole sequence if it has fewer words; empty without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _level(n: int) -> int:
    """Number of parts for sets whose smaller partner has n elements; 0: single elements."""
    return 0 if n < SMALL else 1 << math.ceil(math.log2(0.4 * n))


def tokens(s: np.ndarray, num: int = 80, den: int = 100) -> list[tuple[np.ndarray, int]]:
    """(tokens, differ) of a sorted set for the threshold num/den: at its own level, and at those of its smaller partners if they are others.
    Of the tokens, at most `differ` are missing in a partner."""
    n = len(s)
    if not n:
        return []
    smallest = -(-n * num // den)
    # overlap >= t/(1+t) (n+m), so n + m - 2 overlap <= (1-t)/(1+t) (n+m)
    as_smaller = (den - num) * (n + n * den // num) // (den + num)
    as_larger = (den - num) * 2 * n // (den + num)
    found = [(_at_level(s, _level(n)), as_smaller)]
    for level in {_level(m) for m in (smallest, max(smallest, SMALL))} - {_level(n)} if smallest < n else ():
        found.append((_at_level(s, level), as_larger))
    return found


def _at_level(s: np.ndarray, parts: int) -> np.ndarray:
    if not parts:
        return mix64(s)
    # elements are sorted, and the leading bits choose the part: each part is a run
    part = (s >> np.uint64(64 - int(math.log2(parts)))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return mix64(np.add.reduceat(mix64(s), first) + np.uint64(parts))


def links(sets: list[np.ndarray], num: int = 80, den: int = 100) -> np.ndarray:
    """Which of some sets link: a symmetric boolean matrix. Overlaps add up over chunks of the incidence's columns."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets)
    row = np.repeat(np.arange(k), sizes)
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    count = np.diff(np.concatenate([first, [len(element)]]))
    overlap = np.zeros(k * k)
    for c in (2, 3, 4):  # rare elements: their few pairs of rows each
        at = first[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                overlap += np.bincount(row[at + i] * k + row[at + j], minlength=k * k)
    overlap = overlap.reshape(k, k)
    overlap += overlap.T
    dense = np.flatnonzero(count > 4)
    for a in range(0, len(dense), 4096):
        part = dense[a : a + 4096]
        n = count[part]
        at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x = np.zeros((k, len(part)), np.float32)
        x[row[at], np.repeat(np.arange(len(part)), n)] = 1
        overlap += x @ x.T
    linked = den * overlap >= num * (sizes[:, None] + sizes[None, :] - overlap)
    np.fill_diagonal(linked, False)
    return linked


def _describe(n_words: int, num: int, den: int):
    """For each document: set size, a 128-bit hash of the set, its tokens, and for each level their number and how many places of the first D+1
    are left when each has one (below 0: so many tokens too many). Equal sets of one task give tokens once, so that a group of
    copies, however large, sends no more than a copy for each task; a row with a null id, which links with nothing, gives none."""

    def lists(values: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))

    def run(batches):
        seen: set[bytes] = set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for known, text in zip(batch.column(0).is_valid().to_pylist(), strings(batch.column(1))):
                s = shingle_set(text, n_words)
                key = np.array([mix64(np.add.reduce(mix64(s), keepdims=True))[0], np.bitwise_xor.reduce(mix64(s + np.uint64(1)))], np.uint64) if len(s) else np.zeros(2, np.uint64)
                new = known and len(s) and (b := key.tobytes()) not in seen
                if new:
                    seen.add(b)
                found = tokens(s, num, den) if new else []
                row = (len(s), *key.astype(np.int64).tolist(), np.concatenate([t for t, _ in found]).astype(np.int64) if found else none)
                for c, v in zip(cols, (*row, np.array([len(t) for t, _ in found], np.int64), np.array([d + 1 - len(t) for t, d in found], np.int64))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *map(lists, cols[3:])], names=["doc_id", "n_shingles", "h1", "h2", "sig", "n", "spare"])

    return run


def _shared(near: IdFilter):
    """(doc_id, level, spare, sig): the tokens that a filter of those of several sets hits."""

    def run(batches):
        for batch in batches:
            sig, n, spare = batch.columns[1:]
            of_level = np.repeat(np.arange(len(n.flatten())), n.flatten().to_numpy())
            levels = np.diff(n.offsets.to_numpy())
            level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
            doc = np.repeat(batch.column(0).to_numpy(), levels)
            hit = np.flatnonzero(near.hits(sig.flatten()))
            at = of_level[hit]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(level[at]), pa.array(spare.flatten().to_numpy()[at]), sig.flatten().take(pa.array(hit))], names=["doc_id", "level", "spare", "sig"])

    return run


def jaccard_classes(work: Workspace, docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: class of documents that links of Jaccard >= num/den join.

    Documents without words or with a null text have size 0 and link with nothing; ids must be distinct, and a null id
    is a document of its own. Equal sets link. An empty table gives an empty result."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # 1. sizes and tokens
    described = texts.mapInArrow(lean(_describe(n_words, num, den)), "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>, n array<long>, spare array<long>")
    # tokens are half as large as the texts: they stand in a table of their own, which goes as soon as some are chosen
    given = work.put(described, "tokens")
    described = work.put(given.select("doc_id", "n_shingles", "h1", "h2", (F.size("sig") > 0).alias("gives")), "described")
    full = described.where("n_shingles > 0 and doc_id is not null")
    has = F.col("gives")
    same = full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("b"), F.min(F.when(has, F.col("doc_id"))).alias("t"))
    same = work.put(same, "same")
    # of the copies that give tokens (one for each task at most), the first stands for the set
    equal = full.where(has).select("doc_id", "n_shingles", "h1", "h2").join(same, ["n_shingles", "h1", "h2"])
    equal = work.put(equal.where("doc_id <> t").select("doc_id"), "equal")

    # 2. the rarest D+1 tokens of each set that others have too, a star for each, then clusters. Tables of tokens are written, so that joins can
    # split one that very many documents have
    once = given.where("doc_id is not null and size(sig) > 0").join(equal, "doc_id", "left_anti")
    often = once.select(F.explode("sig").alias("sig")).groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    often = work.put(often, "often")
    near = IdFilter.of(often.select(F.col("sig").alias("doc_id")))
    held = once.select("doc_id", "sig", "n", "spare").mapInArrow(lean(_shared(near)), "doc_id long, level long, spare long, sig long").join(often, "sig")
    level = Window.partitionBy("doc_id", "level")
    chosen = held.withColumn("place", F.row_number().over(level.orderBy("df", "sig"))).withColumn("n", F.count("*").over(level)).where("place <= spare + n")
    chosen = work.put(chosen.select("doc_id", "sig"), "chosen")
    work.drop("tokens")
    work.drop("often")
    first = work.put(chosen.groupBy("sig").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    pairs = chosen.join(first, "sig").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    clusters = components(work, pairs, "candidate")
    clusters = work.put(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    work.drop("chosen")
    work.drop("first")

    # 3. sets of clustered documents meet in blocks of compatible sizes
    again = IdFilter.of(clusters)  # spares most texts the second reading

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(again.hits(batch.column(0))))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, n_words).tobytes() for t in strings(batch.column(1))], pa.binary())], names=["doc_id", "elements"])

    width = math.log(den / num)
    sized = clusters.join(full.select("doc_id", "n_shingles"), "doc_id").withColumn("class", F.floor(F.log(F.col("n_shingles")) / width).cast("int"))
    tally = sized.groupBy("cluster", "class").agg(F.count("*").alias("n"))
    whole = tally.groupBy("cluster").agg(F.sum("n").alias("total"))
    tally = tally.join(whole, "cluster").select("cluster", F.when(F.col("total") <= 2 * BLOCK, 0).otherwise(F.col("class")).alias("class"), "n", "total")
    blocks = tally.groupBy("cluster", "class").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.max("total").alias("total"))
    blocks = blocks.select("cluster", "class", F.when(F.col("total") <= 2 * BLOCK, 1).otherwise(F.col("blocks")).alias("blocks"), (F.col("total") <= 2 * BLOCK).alias("single"))
    # a few dozen size classes at most; written, so that the join below can split a cluster of very many documents
    layout = work.put(blocks.groupBy("cluster").agg(F.first("single").alias("single"), F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("beside")), "layout")
    placed = sized.join(layout, "cluster").withColumn("class", F.when(F.col("single"), 0).otherwise(F.col("class")))
    mine = F.pmod(F.xxhash64("doc_id"), F.element_at("beside", F.col("class")))
    placed = placed.select("doc_id", "cluster", "class", mine.cast("int").alias("block"), *(F.coalesce(F.try_element_at("beside", F.col("class") + d), F.lit(0)).cast("int").alias(name) for d, name in ((-1, "below"), (0, "own"), (1, "above"))))
    # unit (class, block, other class, other block), the lesser first; a document joins every unit that its block is in
    below = F.expr("transform(sequence(0, below - 1), j -> struct(class - 1 as c1, j as b1, class as c2, block as b2))")
    own = F.expr("transform(sequence(0, own - 1), j -> struct(class as c1, least(block, j) as b1, class as c2, greatest(block, j) as b2))")
    above = F.expr("transform(sequence(0, above - 1), j -> struct(class as c1, block as b1, class + 1 as c2, j as b2))")
    none = F.expr("cast(array() as array<struct<c1: int, b1: int, c2: int, b2: int>>)")
    units = F.concat(F.when(F.col("below") > 0, below).otherwise(none), own, F.when(F.col("above") > 0, above).otherwise(none))
    placed = placed.select("doc_id", "cluster", F.explode(units).alias("u")).select("doc_id", "cluster", "u.*")
    found = texts.mapInArrow(lean(sets), "doc_id long, elements binary").join(placed, "doc_id")

    keys = ["cluster", "c1", "b1", "c2", "b2"]

    def meet(batches):
        for rows in groups(batches, keys):
            ids = rows["doc_id"].to_numpy()
            if len(ids) > 1:
                root = ids[forest(links([np.frombuffer(x, np.uint64) for x in rows["elements"].to_pylist()], num, den))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[ids != root]), pa.array(root[ids != root])], names=["a", "b"])

    spread = found.repartition(n_parts, *keys).sortWithinPartitions(*keys, "doc_id")
    verified = spread.mapInArrow(lean(meet), "a long, b long")

    # 4. classes: of sets, then of their documents. The table of sets is written, so that the join can split a set of very many copies
    links_of = work.put(verified, "links")
    moved = same.where("t <> b").select(F.col("t").alias("_t"), F.col("b").alias("_b"))
    for c in ("a", "b"):  # sets go by their smallest id from here on
        links_of = links_of.join(moved, F.col(c) == F.col("_t"), "left").withColumn(c, F.coalesce("_b", c)).drop("_t", "_b")
    classes = components(work, links_of, "class")
    sets_of = same.join(classes, F.col("b") == F.col("id"), "left").select("n_shingles", "h1", "h2", F.coalesce("component", "b").alias("component_id"))
    sets_of = work.put(sets_of, "sets")
    out = described.select("doc_id", "n_shingles", "h1", "h2").join(sets_of, ["n_shingles", "h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
