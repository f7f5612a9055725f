import math
import random

import numpy as np
import pytest

from cyclecast.llm import common, mtree, vectors, vptree


def data(n=700, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    x = centres[rng.integers(0, 9, n)] + 0.15 * rng.normal(size=(n, width))
    x[50:80] = x[50]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    odd = [(n, None), (n + 100, [None] * width), (n + 200, [float("nan")] + [0.0] * (width - 1)), (n + 300, [math.inf] * width), (None, [1.0] * width), (1000, [0.0] * width), (1100, [0.5, -0.25]), (0, rows[0][1])]
    return rows + odd


def usable(rows, zero):
    return {i: v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}


def slow_products(rows, every, k):
    known = {i: [math.floor(256 * x) for x in v] for i, v in usable(rows, True).items()}
    out = []
    for q in (i for i in known if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def slow_nearest(rows, every, k):
    known = usable(rows, False)
    pad = lambda v: [*v, *[0.0] * (8 - len(v))]
    out = []
    for q in (i for i in known if i % every == 0):
        scored = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(pad(known[q]), pad(v)))), i) for i, v in known.items() if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("size", [100, 4096])
def test_top_k_matches_brute_force(spark, monkeypatch, size):
    common.prepare(spark)
    monkeypatch.setattr(vectors, "SHARD_ROWS", size)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 5)
    rows = data()
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int").repartition(4)
    got = mtree.top_k(table, 50, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == slow_products(rows, 50, 5)


@pytest.mark.parametrize("size", [100, 4096])
def test_factor_one_is_exact(spark, monkeypatch, size):
    common.prepare(spark)
    monkeypatch.setattr(vectors, "SHARD_ROWS", size)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 5)
    rows = data()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(map(tuple, vptree.nearest(table, 100, 10, relax=1.0).collect()))
    want = slow_nearest(rows, 100, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_few_or_no_rows(spark):
    common.prepare(spark)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.top_k(few, 50, 5).collect()] == [(0, 1, 3, 256 * 128)]
    assert vptree.nearest(few, 100, 10).count() == 1
    for none in (few.limit(0), few.where("vec_id = 3"), spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")):
        assert mtree.top_k(none, 50, 5).count() == 0 and vptree.nearest(none, 100, 10).count() == 0


def test_stored_bounds_save_distances():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(20, 6))[rng.integers(0, 20, 4000)] + 0.02 * rng.normal(size=(4000, 6))))
    tree = mtree.MTree(x, np.arange(4000), float((x * x).sum(1).max()))
    for i in range(0, 4000, 100):
        scores = x @ x[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert tree.search(x[i], i, 5) == want
    assert tree.distances < 0.5 * 40 * 4000
    near = vptree.VPTree(x, np.arange(4000))
    for i in range(0, 4000, 100):
        near.search(x[i], i, 10, 1.0)
    assert near.distances < 0.5 * 40 * 4000


def test_recall_of_the_default_factor():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    x = centres[rng.integers(0, 10, 3000)] + 0.8 * rng.normal(size=(3000, 64))
    tree = vptree.VPTree(x, np.arange(3000))
    hits = 0
    for i in range(0, 3000, 60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {j for _, j in tree.search(x[i], i, 10, vptree.RELAX)})
    assert hits >= 0.9 * 500
