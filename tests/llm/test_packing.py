import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cyclecast.llm import common, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def slow_cost(places, penalties, window):
    best = [0] + [1 << 60] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            if places[j] - places[i] <= window:
                best[j] = min(best[j], best[i] + window - (places[j] - places[i]) + penalties[j])
    return best[-1]


def test_cuts_cost_least():
    rnd = random.Random(2)
    for _ in range(200):
        places = np.cumsum([0, *(rnd.randint(1, 9) for _ in range(rnd.randint(1, 60)))])
        penalties = np.array([rnd.choice([0, 2, 8]) for _ in places])
        cuts = packing.choose_cuts(places, penalties, 16)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        steps = [places[b] - places[a] for a, b in zip(cuts, cuts[1:])]
        assert max(steps) <= 16
        assert sum(16 - s for s in steps) + sum(penalties[c] for c in cuts[1:]) == slow_cost(places, penalties, 16)


def check(rows, texts, window):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    fill = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        fill.append(at)
        order = [p.doc_id for p in sorted(pieces, key=lambda p: p.offset)]
        assert order == sorted(order)
    return fill


def corpus(n=300):
    rnd = random.Random(8)
    vocab = ["alpha", "beta", "gamma", "naïve", "中文", "x", "delta.", "Is", "and,", "end.\n"]
    return {i: " ".join(rnd.choices(vocab, k=int(rnd.paretovariate(0.7)) % 6000)) for i in range(n)}


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    common.prepare(spark)
    texts = corpus() | {1000: None, 1001: "", 1002: "<|endoftext|> word" * 400, 1003: "a" * 20000}
    docs = spark.createDataFrame([(*r, 1) for r in texts.items()], "doc_id long, text string, start int").repartition(2)
    fill = check(packing.pack(docs, PATH, PATTERN).collect(), texts, 1024)
    assert sum(1024 - f for f in sorted(fill)[2:]) < 0.03 * sum(fill)


def test_blocks_join_without_a_seam():
    ends = np.zeros(50, bool)
    ends[7] = True
    rnd = random.Random(1)
    docs = {i: np.array([*(rnd.randrange(1, 50) for _ in range(rnd.randint(0, 400))), 0], "<u4") for i in range(200)}
    old, packing.BLOCK = packing.BLOCK, 500
    try:
        packer, rows = packing._Packer(ends, 64, 7), []
        for i, ids in docs.items():
            rows += packer.add(i, ids)
        rows += packer.plan(last=True)
    finally:
        packing.BLOCK = old
    got = defaultdict(list)
    fill = defaultdict(int)
    for doc_id, start, length, crc, total, sequence, offset in rows:
        assert start == sum(x for x in got[doc_id]) and total == len(docs[doc_id]) and offset == fill[sequence]
        assert crc == zlib.crc32(docs[doc_id][start : start + length])
        got[doc_id].append(length)
        fill[sequence] += length
    assert all(sum(got[i]) == len(ids) for i, ids in docs.items())
    assert max(fill.values()) <= 64 and sum(fill.values()) > 0.9 * 64 * (len(fill) - 1)


def test_empty_table_and_repeated_rows(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    assert packing.pack(docs.limit(0), PATH, PATTERN).count() == 0
    got = packing.pack(docs, PATH, PATTERN)
    assert got.count() == 3 and got.agg(F.sum("length")).first()[0] == 8
