"""Neighbours and centroids against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesmith.llm import centroids, neighbours

ROWS = "vec_id long, embedding array<float>, label int, row long, n int, rank int, cluster int, x string, far double, id string"


def vectors(rng, n, d=64, groups=12, spread=0.6):
    middle = rng.standard_normal((groups, d))
    v = middle[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, "x", 0.5, "y") for i, v in rows], ROWS)


def awkward(d=64):
    """Rows that take no part in a search."""
    one = [1.0] + [0.0] * (d - 1)
    return [(100, None), (200, []), (300, [0.0] * d), (400, [None] + one[1:]), (500, [math.nan] + one[1:]), (600, [math.inf] + one[1:])]


def far(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):  # added in order, unlike sum()
        total += (float(x) - float(y)) ** 2
    return math.sqrt(total)


def true_nearest(rows, k, every):
    good = [(i, v, at) for at, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q, at in good:
        if i is not None and i % every == 0:
            near = []
            for j, v, other in good:
                if other != at and len(v) == len(q):
                    near.append((far(v, q), j if j is not None else 1 << 62))
            out.setdefault(i, []).append(sorted(near)[:k])
    return out


def found_nearest(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id if r.vec_id is not None else 1 << 62))
    return out


def test_nearest_recall(spark, written):
    rng = np.random.default_rng(3)
    rows = list(enumerate(vectors(rng, 1000) + vectors(rng, 1000, spread=3.0)))
    for spread in (0, 1):
        mine = rows if spread == 0 else rows[1000:]
        want = true_nearest(mine, 10, 100)
        got = found_nearest(neighbours.nearest(written(table(spark, mine)), F.col("vec_id") % 100 == 0))
        hits = sum(len(set(got[q]) & set(w[0])) for q, w in want.items())
        assert set(got) == set(want) and hits >= 0.98 * sum(len(w[0]) for w in want.values())
        assert all(got[q] == sorted(got[q]) and len(got[q]) == 10 for q in got)


def test_nearest_parts_ties_and_nulls(spark, written, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 40)
    rng = np.random.default_rng(4)
    base = vectors(rng, 60, d=5)
    rows = [(i, base[i % 60]) for i in range(150)] + [(1000 + i, base[0]) for i in range(40)] + [(None, base[1]), (None, base[1])]
    rows += [(700, [3.0, 4.0]), (701, [3.0, 5.0]), (800, [1e30] * 3)] + awkward()
    want = {q: w[0] for q, w in true_nearest(rows, 10, 100).items()}
    got = found_nearest(neighbours.nearest(written(table(spark, rows)), F.col("vec_id") % 100 == 0))
    assert got == {q: w for q, w in want.items() if w} and got[700] == [(1.0, 701)] and 800 not in got
    assert [r[1] for r in got[0][:2]] == [60, 120]


def test_nearest_of_repeated_rows_and_empty_tables(spark, written):
    v = vectors(np.random.default_rng(5), 3, d=4)
    got = found_nearest(neighbours.nearest(written(table(spark, [(100, v[0]), (100, v[0]), (1, v[1])])), F.col("vec_id") % 100 == 0, k=1))
    assert got == {100: [(0.0, 100), (0.0, 100)]}
    for rows in ([], awkward(), [(100, v[0])]):
        df = neighbours.nearest(written(table(spark, rows), parts=1), F.col("vec_id") % 100 == 0)
        assert df.count() == 0 and df.columns == ["query_id", "rank", "vec_id", "score"]


def test_windows_stop_early():
    """On vectors in groups, the search counts and verifies a part of them only."""
    rng = np.random.default_rng(6)
    v = np.array(vectors(rng, 4000, groups=40, spread=0.05), np.float32)
    index = neighbours.SortedProjections(v, np.arange(4000), np.arange(4000), 10)
    checked, plain = [], neighbours.distances
    neighbours.distances = lambda x, q: checked.append(len(x)) or plain(x, q)
    try:
        list(index.search(v[:50], np.arange(50)))
    finally:
        neighbours.distances = plain
    assert sum(checked) < 0.2 * 50 * 4000


def test_loose_vectors_are_searched_in_blocks(monkeypatch):
    """Where windows tell little apart, few vectors beyond the radius are verified in double precision, and none of the nearest is lost."""
    rng = np.random.default_rng(9)
    v = np.array(vectors(rng, 8000, spread=3.0), np.float32)
    index = neighbours.SortedProjections(v, np.arange(8000), np.arange(8000), 10)
    checked, plain = [], neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda x, q: checked.append(len(x)) or plain(x, q))
    found = [set(index.ids[places].tolist()) for places, _ in index.search(v[:100], np.arange(100))]
    assert sum(checked) < 0.05 * 100 * 8000
    far = np.array([plain(v, q) for q in v[:100]])
    far[np.arange(100), np.arange(100)] = np.inf
    assert sum(len(set(w) & f) for w, f in zip(far.argsort(axis=1)[:, :10].tolist(), found, strict=True)) >= 990


def test_counts_in_bit_slices():
    rng = np.random.default_rng(10)
    for n in (1, 2, 3, 7, 64):
        bits = rng.random((n, 5, 128)) < rng.random((1, 5, 128))
        maps = [np.packbits(b, axis=1, bitorder="little").view(np.uint64) for b in bits]
        for least in (1, 2, n, n + 1, 47, 64, 200):
            got = np.unpackbits(neighbours.often((m.copy() for m in maps), least).view(np.uint8), axis=1, bitorder="little")
            assert (got.astype(bool) == (bits.sum(axis=0) >= least)).all()


def test_queries_beyond_single_precision():
    v = np.random.default_rng(11).standard_normal((300, 4)).astype(np.float32) * np.float32(1e-9)
    index = neighbours.SortedProjections(v, np.arange(300), np.arange(300), 5)
    query = np.full((1, 4), 1e25, np.float32)
    ((places, far),) = index.search(query, np.array([1000]))
    assert len(places) == 5 and (far == neighbours.distances(index.vectors[places], query[0])).all()


def lloyd(rows, k=8, rounds=10, d=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        for n, m in members.items():
            middle[n] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    per = {}
    for _, far, n in found:
        per[n] = per.get(n, 0) + far
    return sorted(((i, n, far, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()) for i, far, n in found), key=repr)


@pytest.mark.parametrize("case", ["plain", "copies", "few", "none"])
def test_kmeans(spark, written, case):
    rng = np.random.default_rng(7)
    base = [[float(np.float32(x)) for x in v] for v in vectors(rng, 200)]
    rows = {
        "plain": list(enumerate(base)) + awkward() + [(7000, base[0][:63]), (None, base[3]), (5, base[9]), (5, base[9])],
        "copies": [(i, base[i % 3]) for i in range(120)],
        "few": list(enumerate(base[:5])),
        "none": awkward()[:2],
    }[case]
    got = centroids.kmeans(written(table(spark, rows)))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows)


def test_kmeans_of_an_empty_table_and_large_components(spark, written):
    assert centroids.kmeans(written(table(spark, []))).count() == 0
    rows = [(i, [float((-1) ** i * 100_000 + i * j) for j in range(64)]) for i in range(12)]
    assert sorted((tuple(r) for r in centroids.kmeans(written(table(spark, rows))).collect()), key=repr) == lloyd(rows)
    with pytest.raises(Exception, match="too large"):
        centroids.kmeans(written(table(spark, [(1, [1e9] * 64)]))).collect()


def test_pivots_rule_out_centroids():
    rng = np.random.default_rng(8)
    x = np.floor(1024 * np.array(vectors(rng, 3000, groups=8, spread=0.1))).astype(np.int64)
    middle, pivots = x[:8].copy(), centroids.far_pivots(x[:1000])
    far = np.stack([centroids.squared(x, p) for p in pivots], axis=1)
    number, best, asked = centroids.assign(x, far, middle, pivots)
    every = np.stack([centroids.squared(x, c) for c in middle], axis=1)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and asked < 0.5 * every.size
    assert len(centroids.far_pivots(np.ones((5, 3), np.int64))) == 1
