import itertools
import random

import numpy as np

from vigil.llm.common import Workspace, components
from vigil.llm.ngram_join import jaccard_classes, links, tokens

from .helpers import BASE, least_reachable, odd_documents, shingles


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    holders = {}
    for i, s in sets:
        for x in s:
            holders.setdefault(x, []).append(i)
    by_id = dict(sets)
    near = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    pairs = [(a, b) for a, b in near if 100 * len(by_id[a] & by_id[b]) >= 80 * len(by_id[a] | by_id[b])]
    return {i: (len(by_id[i]), c) for i, c in least_reachable(by_id, pairs).items()}


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, cluster string, sig long")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(Workspace(spark), df).collect()}


def test_odd_documents(spark):
    docs = odd_documents()
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs[:0]) == {}


def test_random_near_copies(spark):
    rnd = random.Random(5)
    docs = []
    for g in range(25):
        base = [rnd.choice(BASE) + str(rnd.randrange(40)) for _ in range(rnd.choice([6, 20, 70, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rnd.randrange(0, 2 + len(w) // 25)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = [str(rnd.random())] * rnd.randrange(3)
            docs.append((len(docs), " ".join(w)))
    assert run(spark, docs) == brute(docs)


def first_tokens(s, order):
    """What a set chooses of its tokens under an order of all tokens."""
    return set().union(*(sorted(t.tolist(), key=lambda x: hash((order, x)))[: d + 1] for t, d in tokens(s)))


def test_linked_sets_share_a_first_token_in_any_order():
    rnd = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rnd.integers(1, 260))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        keep = a[rnd.random(len(a)) > rnd.choice([0.0, 0.05, 0.1, 0.2])]
        b = np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, int(rnd.integers(0, 1 + n // 8))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        linked = both and 100 * both >= 80 * (len(a) + len(b) - both)
        if linked and len(a) != len(b) or linked and both < len(a):
            assert first_tokens(a, n) & first_tokens(b, n)
        if len(b):
            assert links([a, b])[0, 1] == bool(linked)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300), (500, 501), (501, 502), (502, 500)]
    got = {r.id: r.component for r in components(Workspace(spark), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = {i: c for i, c in least_reachable({x for e in edges for x in e}, edges).items() if i != 300}
    assert got == want


def test_a_copy_with_a_null_id_comes_first(spark):
    docs = [(None, " ".join(BASE)), (1, " ".join(BASE)), (2, " ".join([*BASE, "tail"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_classes(Workspace(spark), df).collect()}
    assert got == {None: None, 1: 1, 2: 1}


def test_copies_whose_smallest_id_comes_last(spark):
    """The copy that gives a set's tokens isn't the one of the smallest id."""
    texts = [(9, " ".join(BASE)), (8, " ".join([*BASE, "tail"])), (3, " ".join(BASE)), (5, " ".join([*BASE, "tail"])), (4, "else")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in jaccard_classes(Workspace(spark), df).collect()} == {9: 3, 8: 3, 3: 3, 5: 3, 4: 4}


def test_a_shared_passage_brings_nobody_together(spark):
    """Documents of their own words and a passage that all have: none links, and none is compared."""
    rnd = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rnd.random()}" for _ in range(120)) + " " + passage) for i in range(300)] + [(300, "x " + passage), (301, "y " + passage)]
    work = Workspace(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_classes(work, df).collect()}
    assert got == {i: c for i, (_, c) in brute(docs).items()}
    assert spark.read.parquet(work.path("clusters")).count() <= 2
