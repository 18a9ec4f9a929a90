import numpy as np

from vigil.llm.common import Workspace
from vigil.llm.embedding_dedup import Codes, cosine_classes
from vigil.llm.nearest import hilbert_keys, nearest

from .helpers import least_reachable

SCHEMA = "vec_id long, embedding array<float>, label int, id long, copies long"


def odd_vectors(n=700, dim=12, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[50]
    x[90:130] = x[90] + r.normal(size=(40, dim)).astype(np.float32) * 0.15
    rows = [[float(c) for c in v] for v in x]
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0], rows[50], [2 * c for c in rows[50]], [-c for c in rows[50]], [1e-30 * c for c in rows[3]]]
    return [(i, v, 0, 5, 6) for i, v in enumerate(rows)], dim


def good(rows, dim):
    return {i: np.array(v, np.float64) for i, v, *_ in rows if v and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(v)}


def test_cosine_classes(spark):
    rows, dim = odd_vectors()
    v = good(rows, dim)
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (u @ u.T) >= 0.9
    np.fill_diagonal(linked, False)
    n = dict(zip(ids.tolist(), linked.sum(axis=1).tolist()))
    root = least_reachable([r[0] for r in rows], [(ids[a].item(), ids[b].item()) for a, b in zip(*np.nonzero(linked))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine_classes(Workspace(spark), spark.createDataFrame(rows, SCHEMA), tile=150, least=150).collect()}
    assert got == {i: (n.get(i, 0), root[i], root[i] == i) for i, *_ in rows}
    assert cosine_classes(Workspace(spark), spark.createDataFrame([], SCHEMA)).count() == 0


def test_quantisation_bounds_hold():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(300, 40)), r.standard_cauchy((300, 40)), 1e-200 * r.normal(size=(50, 40)), 1e200 * r.normal(size=(50, 40))])
    c = Codes.of(x)
    u = x / np.abs(x).max(axis=1)[:, None]
    u = u / np.linalg.norm(u, axis=1)[:, None]
    assert (np.abs(c.products(c) - u @ u.T) <= c.coarse[:, None] + (1 + c.coarse[:, None]) * c.coarse[None, :] + 1e-9).all()
    assert (np.abs(c.close() @ c.close().T - u @ u.T) <= c.fine[:, None] + (1 + c.fine[:, None]) * c.fine[None, :] + 1e-9).all()
    assert c.fine.max() < 1e-4
    wide = Codes.of(r.normal(size=(20, 3000)))
    assert np.array_equal(wide.products(wide), (wide.q.astype(np.int64) @ wide.q.T.astype(np.int64)) * (wide.scale[:, None] * wide.scale[None, :]))


def test_pairs_in_doubt_are_decided_by_doubles(spark):
    """Cosines a hair on either side of the threshold, closer to it than the codes can tell; tiny numbers; lengths of their own."""
    c = [0.9 + 1e-7, 0.9 - 1e-7]
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [c[0], float(np.sqrt(1 - c[0] ** 2)), 0.0, 0.0]), (2, [c[1], 0.0, float(np.sqrt(1 - c[1] ** 2)), 0.0])]
    rows += [(10, [1e-200, 2e-200]), (11, [2e-200, 4e-200]), (12, [1.0, -1.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 3.0])]
    rows += [(30, [0.0] * 5 + [1.0]), (30, [1.0] + [0.0] * 5), (31, [1.0] + [0.0] * 5), (None, [1.0, 0.0, 0.0, 0.0]), (None, None)]
    found = cosine_classes(Workspace(spark), spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=2).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in found)
    assert got == [(-1, 0, -1, True), (-1, 0, -1, True), (0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True),
                   (20, 1, 20, True), (21, 1, 20, False), (30, 0, 30, True), (30, 1, 30, True), (31, 1, 30, False)]


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rows, dim = odd_vectors(2000, 12)
    v = good(rows, dim)
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    got = {}
    for r in nearest(Workspace(spark), spark.createDataFrame(rows, SCHEMA), reach=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    assert set(got) == {i for i in v if i % 100 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        d = np.sqrt(((x - v[q]) ** 2).sum(axis=1))
        want = [i for _, i in sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]]
        for _, i, s in found:
            assert abs(s - np.sqrt(((v[i] - v[q]) ** 2).sum())) < 1e-12
        hits, total = hits + len(set(want) & {f[1] for f in found}), total + 10
    assert hits / total >= 0.9
    assert nearest(Workspace(spark), spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(Workspace(spark), spark.createDataFrame(rows[:4], SCHEMA)).count() == 3


def test_windows_reach_over_many_ranges(spark):
    """The same candidates whether a window lies in one range or in dozens: the places of rows are exact."""
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    few, many = (sorted(tuple(q) for q in nearest(Workspace(spark), df, reach=250, range_rows=n).collect()) for n in (10_000, 120))
    hits = {}
    for name, found in (("few", few), ("many", many)):
        for q, _, i, _ in found:
            d = ((x - x[q]) ** 2).sum(axis=1)
            hits[name] = hits.get(name, 0) + (d[i] <= np.sort(d)[10])
    assert hits["many"] >= hits["few"] >= 0.9 * 150
    whole = nearest(Workspace(spark), df, reach=1500, range_rows=300).collect()
    assert sum(((x - x[q.query_id]) ** 2).sum(axis=1)[q.vec_id] <= np.sort(((x - x[q.query_id]) ** 2).sum(axis=1))[10] for q in whole) == 150


def test_nearest_across_ranges_lengths_and_copies(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(600, 3)), r.normal(size=(40, 2))
    a[100:300] = a[100]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(1000 + i, v.tolist()) for i, v in enumerate(b)]
    rows += [(1000, b[0].tolist()), (None, a[0].tolist()), (2000, None)]
    found = {}
    for x in nearest(Workspace(spark), spark.createDataFrame(rows, "vec_id long, embedding array<double>"), reach=60, range_rows=150).collect():
        found.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert set(found) == {0, 100, 200, 300, 400, 500, 1000}
    hits = 0
    for q, got in found.items():
        part, base = (a, 0) if q < 1000 else (b, 1000)
        d = np.sqrt(((part - part[q - base]) ** 2).sum(axis=1))
        want = sorted((s, i + base) for i, s in enumerate(d.tolist()) if i + base != q)[:10]
        assert len(got) == 10 and q not in [i for _, i in got] and len({i for _, i in got}) == 10
        if q in (100, 200):
            assert sorted(got) == want  # copies at distance 0, smallest ids first
        hits += len({i for _, i in got} & {i for _, i in want})
    assert hits >= 0.9 * 70


def test_nearest_far_from_the_origin_and_in_knots(spark):
    """Distances that are small beside the vectors themselves, or beside those between knots: codes of whole vectors can't tell them apart."""
    r = np.random.default_rng(11)
    n, dim = 3000, 32
    knots = r.normal(size=(3, dim))[np.arange(n) % 3] + 1e-3 * r.normal(size=(n, dim))
    for x in (r.normal(size=(n, dim)) + 100, knots, np.concatenate([1000 * r.normal(size=(n, 1)), r.normal(size=(n, dim - 1))], 1)):
        rows = nearest(Workspace(spark), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
        far = {q: ((x - x[q]) ** 2).sum(axis=1) for q in range(0, n, 100)}
        assert len(rows) == 10 * len(far)
        assert sum(far[q.query_id][q.vec_id] <= np.partition(far[q.query_id], 10)[10] for q in rows) >= 0.9 * len(rows)
