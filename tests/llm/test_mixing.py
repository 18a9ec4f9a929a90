import random
from collections import defaultdict

from vigil.llm.common import Workspace
from vigil.llm.mixing import apportion, mix, targets

from .helpers import WORDS, odd_documents

SCHEMA = "doc_id long, text string, source string, size long, shard long"


def brute_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_taken(spark):
    rnd = random.Random(4)
    rows = [(i, t, rnd.choice(["b", "a", "ä", "Z", None, "empty"]) if t and t.strip() else "empty0", 1, 2) for i, t in odd_documents()]
    rows += [(1000 + i, " ".join(["x"] * rnd.randrange(400)), rnd.choice(["hot"] * 6 + ["a", "b", None, "c", "d"]), 1, 2) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mix(Workspace(spark), df, shard_words=20_000).collect()}
    sizes, source = defaultdict(int), {}
    for i, t, s, *_ in rows:
        n = len(WORDS.findall(t or ""))
        assert got[i].size == n
        sizes[s] += n
        source[i] = s
    want, taken = brute_targets(sizes), defaultdict(int)
    for i, r in got.items():
        assert r.source_size == sizes[source[i]] and abs(r.target - want[source[i]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source[i]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200 + 0.01 * want[s], s
    again = {r.doc_id: r for r in mix(Workspace(spark), df.repartition(7), shard_words=20_000).collect()}
    assert again == got
    assert mix(Workspace(spark), df.limit(0)).count() == 0


def test_apportionment_takes_highest_quotients(spark):
    rnd = random.Random(2)
    for seats in (0, 1, 7, 100, 12345):
        votes = {f"p{i:02}": float(rnd.choice([0, 1, 5, 5, 1000, rnd.randrange(10**6)])) for i in range(17)}
        df = spark.createDataFrame([(1, k, v) for k, v in votes.items()], "g int, party string, votes double")
        from pyspark.sql import functions as F

        got = {r.party: r.quota for r in apportion(df, ["g"], ["party"], F.lit(seats)).collect()}
        ranked = sorted(((-v / (2 * s + 1), k) for k, v in votes.items() if v for s in range(min(seats, int(seats * v / sum(votes.values())) + 30))))[:seats]
        assert got == {k: sum(1 for _, p in ranked if p == k) for k in votes}


def test_targets_fill_up(spark):
    rnd = random.Random(9)
    for _ in range(4):
        sizes = {s: rnd.randrange(1, 10 ** rnd.randrange(1, 6)) for s in ["a", "b", "c", "d", "e", None]}
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, 2.0).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_small_sources_get_their_share(spark):
    rows = [(i, " ".join(["x"] * 10), f"s{i:02}", 0, 0) for i in range(12)] + [(99, "y " * 3000, "t", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in (df.where("doc_id < 99"), df):
        for r in mix(Workspace(spark), part).collect():
            assert abs(r.taken - r.target) <= 1 and r.taken <= 2 * r.size, r


def test_many_equal_rows_are_dealt_to_many_shards(spark, monkeypatch):
    """A third of all rows are equal, with a null id: the shards they fall into stay near the others' size, and reruns agree."""
    from vigil.llm import mixing

    largest = []
    monkeypatch.setattr(mixing, "apportion", lambda votes, within, party, seats: (largest.append([r.votes for r in votes.select("votes").collect()]), apportion(votes, within, party, seats))[1])
    rows = [(None, "copied words here and there", "s", 0, 0)] * 4000 + [(i, f"row {i} of the rest", "s", 0, 0) for i in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = [sorted((r.doc_id or -1, r.taken) for r in mix(Workspace(spark), x, shard_words=2000, copies=100).collect()) for x in (df, df.repartition(5))]
    shards = largest[1]
    assert len(shards) > 20 and max(shards) < 2.5 * sum(shards) / len(shards)
    assert taken[0] == taken[1] and len(taken[0]) == 12_000
