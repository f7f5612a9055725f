import zlib
from collections import Counter, defaultdict

import pytest

from cyclecast.llm import common, sharding


def data():
    rows = [(i, f"text {i % 7}" * (i % 50), "en") for i in range(1003)]
    return [*rows, *[(5, "same", "en")] * 400, (None, None, None), (2000, "", "é"), (2001, "é中" * 4000, "x")]


@pytest.mark.parametrize("size", [3000, 100_000, 16 << 20])
def test_law_and_slots(spark, monkeypatch, size):
    common.prepare(spark)
    docs = spark.createDataFrame(data(), "doc_id long, text string, shard string").repartition(5)
    monkeypatch.setattr(sharding, "CHUNK", 16)
    monkeypatch.setattr(sharding, "FEW", 0 if size == 3000 else 10**6)
    monkeypatch.setattr(sharding, "BUCKET_BYTES", size)
    shuffle = sharding.shuffle_shards
    monkeypatch.setattr(sharding, "shuffle_shards", lambda rows, shards, seed: shuffle(rows, shards, seed, size))
    found = sharding.shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_is_shuffled_seeded_and_repeatable(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "doc_id long, text string")

    def order(seed, rows=docs):
        return [r.doc_id for r in sorted(sharding.shuffle_shards(rows, 3, seed, 12_000).collect(), key=lambda r: (r.slot, r.shard))]

    first = order(1)
    assert first == order(1, docs.repartition(7)) and first != order(2) and first != sorted(first)
    assert sorted(first) == list(range(2000))
    near = sum(abs(a - b) == 1 for a, b in zip(first, first[1:]))
    assert near < 20


def test_empty_and_clashing_names(spark, tmp_path):
    common.prepare(spark)
    docs = spark.createDataFrame(data(), "doc_id long, Shard string, slot string")
    got = sharding.shuffle_shards(docs)
    assert got.columns == ["doc_id", "Shard", "slot", "_shard", "_slot"] and got.count() == len(data())
    assert sharding.shuffle_shards(docs.limit(0)).count() == 0
    assert sharding.shuffle_shards(docs.where("doc_id = 5")).count() == 401


def test_written_shards_hold_whole_rows_in_order(spark, tmp_path):
    common.prepare(spark)
    docs = spark.createDataFrame(data(), "doc_id long, text string, lang string")
    sharding.write_shards(docs, str(tmp_path / "out"), 4, 1, 20_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.lang) for r in back.collect()) == Counter(data())
    counts = [r[0] for r in back.groupBy("shard").agg({"*": "count"}).select("count(1)").collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
