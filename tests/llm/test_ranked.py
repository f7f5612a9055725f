import math
import random
import re
from collections import Counter

import numpy as np

from cyclecast.llm import common, ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k):
    docs = [(d, Counter(words(t))) for d, t in docs if d is not None]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words(text))
    out = []
    for item, own in asked.items():
        found = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(seed, n, vocabulary=60):
    rnd = random.Random(seed)
    pool = [f"{'W' if i % 3 else 'é'}{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rnd.choices(pool, weights, k=rnd.choice([0, 3, 10, 40, 200]))).replace(" ", rnd.choice([" ", "_", "\x7f", "-"]))) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    common.prepare(spark)
    rows = corpus(1, 700)
    rows += [(None, "w1 w2"), (900, None), (901, ""), (5, rows[5][1]), (5, "w1 other"), (902, "\x00 - _"), (903, "w7 " * 50_000 + "W8 w9"), (-4, rows[9][1])]
    items = [(i, t) for i, t in corpus(2, 40)] + [(7, "w1 W1 w59"), (100, None), (None, "w1"), (101, "absent terms"), (102, "...")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, term string").repartition(3)
    queries = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = slow(rows, items, 20)
    assert len(want) > 500
    for shard, query_bytes in ((1 << 20, 16 << 20), (500, 16 << 20), (3000, 2000)):
        monkeypatch.setattr(ranked, "SHARD_POSTINGS", shard)
        monkeypatch.setattr(ranked, "QUERY_BYTES", query_bytes)
        assert sorted(tuple(r) for r in ranked.search(docs, queries, 20).collect()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).collect() == [] and ranked.search(docs, items.limit(0)).collect() == []
    assert ranked.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_the_cheapest(spark):
    rnd = np.random.default_rng(4)
    lists = [rnd.integers(1, 1000, n) ** rnd.integers(1, 3) for n in (1, 2, 9, 30, 30, 75)] + [np.full(20, 7)]
    starts = ranked.block_starts(np.concatenate(lists), np.cumsum([len(x) for x in lists]), longest=12, price=2)
    at = 0
    for x in lists:
        price = max(2 * (x.max() - x.mean()), 1)
        best = [0.0]
        for i in range(1, len(x) + 1):
            best.append(min(best[i - n] + n * x[i - n : i].max() + price for n in range(1, min(i, 12) + 1)))
        cuts = [*np.flatnonzero(starts[at : at + len(x)]), len(x)]
        assert cuts[0] == 0
        assert abs(sum((b - a) * x[a:b].max() + price for a, b in zip(cuts, cuts[1:])) - best[-1]) < 1e-6
        at += len(x)


def test_blocks_are_skipped():
    scored = []

    class Counting(ranked._Shard):
        def _score(self, own, low, high, best):
            scored.append(int((high - low).sum()))
            super()._score(own, low, high, best)

    rnd = np.random.default_rng(5)
    n = 20_000
    tf = np.minimum(rnd.geometric(0.5, n) + 50 * (np.arange(n) // 500 == 7), 60)
    shard = Counting(np.arange(n), np.full(n, 100), np.ones(n, int), np.zeros(n, np.int32), tf, np.array([1000]))
    best = ranked._Best(10)
    shard.search(np.array([0]), best)
    assert sum(scored) < n / 4 and best.doc.tolist() == np.lexsort((np.arange(n), -tf))[:10].tolist()
