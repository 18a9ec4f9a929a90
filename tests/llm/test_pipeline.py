from collections import Counter

import corpus_pipeline as P
from vigil.llm.common import Workspace
from vigil.llm.mixing import mix

from .helpers import BASE, WORDS, least_reachable, odd_documents, shingles
from .test_ngram_join import brute
from .test_secrets import brute as brute_spans

DIR = "/root/testdata/sf0.001"


def test_near_duplicates_keep_the_smallest_id(spark):
    rows = [(i, t, "en", "s", 0) for i, t in odd_documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_duplicates(spark, docs, DIR)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in brute(odd_documents()).items() if i == c}


def test_secrets_are_masked(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: r for r in P.secret_scan(spark, docs, DIR).collect()}
    for r in docs.collect():
        text, at = "", 0
        for s in brute_spans(r.text):
            _, a, b = s.split(":")
            if int(a) >= at:
                text += r.text[at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        assert got[r.doc_id].text == text + r.text[at:] and got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_mix_takes_the_words(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = {r.doc_id: r.taken for r in mix(Workspace(spark), docs).collect() if r.taken}
    got = Counter()
    for r in P.source_mix(spark, docs, DIR).collect():
        got[r.doc_id] += len(WORDS.findall(r.text))
    assert got == want


def test_whole_run(spark):
    kept = spark.read.parquet(f"{DIR}/documents.parquet").count()
    out = P.run(spark, DIR).collect()
    assert out and max(r.offset + r.length for r in out) <= 1024
    assert len({r.doc_id for r in out}) <= kept
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert sum(used.values()) >= 0.9 * 1024 * (len(used) - 1)
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_duplicates", "secret_scan", "source_mix", "best_fit_packing"]
    assert least_reachable([1], []) == {1: 1} and not shingles(None)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_of_repeated_and_null_ids(spark):
    base, tail, other = " ".join(BASE), " ".join([*BASE, "tail"]), "quite another text of some words " * 3
    texts = [(None, base), (None, base), (3, base), (2, tail), (2, tail), (2, other), (None, other + "x"), (7, None), (7, None), (8, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).repartition(3)
    got = Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, DIR).collect())
    assert got == Counter([(2, tail), (2, other), (7, None), (8, None), (None, "")])


def test_secrets_of_repeated_and_null_ids(spark):
    a, b, c = "first password: hunter2hunter2 end", "a longer beginning, then password: swordfish99 end", "token= Zebra77zebra77 tail"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(None, a), (5, b), (5, c), (5, "nothing"), (None, None)]], DOCS)
    got = Counter((r.doc_id, r.text) for r in P.secret_scan(spark, docs, DIR).collect())
    assert got == Counter([(None, "first [SECRET] end"), (5, "a longer beginning, then [SECRET] end"), (5, "[SECRET] tail"), (5, "nothing"), (None, None)])


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(i, " ".join(f"w{n}x{j}" for j in range(50 + n)), "en", "ab"[n % 2], 0) for n, i in enumerate([None] * 40 + [1] * 40 + list(range(100, 140)))]
    docs = spark.createDataFrame(rows, DOCS)
    want = sum(r.taken for r in mix(Workspace(spark), docs).collect())
    got = Counter()
    for r in P.source_mix(spark, docs, DIR).collect():
        words = WORDS.findall(r.text)
        assert len({w.split("x")[0] for w in words}) == 1
        got[r.doc_id, words[0].split("x")[0]] += len(words)
    size = {(i, f"w{n}"): 50 + n for n, (i, *_) in enumerate(rows)}
    assert sum(got.values()) == want and all(n <= 2 * size[k] for k, n in got.items())


def test_columns_that_clash_with_the_operators(spark):
    """Every stage over documents whose further columns bear the operators' names; empty tables too."""
    names = ["size", "spans", "epochs", "_row", "class", "taken", "all_spans", "_doc", "sig", "shard", "length", "offset", "component_id", "cut_from"]
    texts = odd_documents()[:25] + [(None, "password: hunter2hunter2 " + " ".join(BASE)), (3, "an id of another text " * 4)]
    schema = DOCS + ", " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "ab"[k % 2], 0, *range(len(names))) for k, (i, t) in enumerate(texts)], schema)
    for name, stage in P.STAGES:
        out = stage(spark, docs, DIR)
        rows = out.collect()
        assert rows, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in rows), name
        assert stage(spark, docs.limit(0), DIR).count() == 0, name


def test_rejected_documents_go(spark):
    from vigil.llm.common import table
    from vigil.llm.quality import fit, score_quality

    rows = [(i, t, "en", "s", 0) for i, t in odd_documents()] + [(None, "no id at all", "en", "s", 0), (3, "the same id, another text", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    net = fit(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    want = Counter()
    for i, t, *_ in rows:
        one = spark.createDataFrame([(i, t)], "doc_id long, text string")
        want[i, t] += score_quality(one, net).first().predicted
    assert Counter((r.doc_id, r.text) for r in P.quality_classifier(spark, docs, DIR).collect()) == +want
