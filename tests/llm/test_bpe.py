import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cyclecast.llm import bpe, common

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts(n=400):
    rnd = random.Random(4)
    bits = ["a", "b", "e", "the", "ing", "é", "中", "😀", " ", "  ", "\n", "1", "23", "!!", "==", "ﬁ", "'s", "aaaa", "‍", "\t"]
    made = ["".join(rnd.choices(bits, k=rnd.randint(1, 60))) for _ in range(n)]
    return [*made, "", "a" * 3000, " " * 500, "ab" * 900, "=-" * 300, "<|endoftext|>", "the " * 5000]


def test_ids_are_those_of_the_library(reference):
    machine = bpe.Transducer(bpe.read_ranks(PATH), PATTERN)
    for text in texts():
        assert machine.encode(text) == reference.encode_ordinary(text)


def test_forgetting_states_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    machine = bpe.Transducer(bpe.read_ranks(PATH), PATTERN)
    for text in texts(60):
        assert machine.encode(text) == reference.encode_ordinary(text)


def test_streaming_decoder_keeps_unfinished_code_points():
    text = "aé中😀z" * 5
    for size in (1, 2, 3, 5):
        stream, data = bpe.Utf8Stream(), text.encode()
        parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(parts) + stream.finish() == text
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xf0\x9f") == "a" and stream.finish() == "�"


def test_json_and_rank_file_agree():
    assert bpe.read_ranks(PATH) == bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.json"))


def test_queries_over_rows(spark, reference):
    common.prepare(spark)
    rows = [(i, t, "x") for i, t in enumerate(texts(30))] + [(900, None, None), (None, "b", "y"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), t or "")]
        want.append((i, len(ids), *sha))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id < 30 and text <> 'again'"), PATH, PATTERN), PATH, PATTERN).collect()}
    assert all(back[i] == t for i, t, _ in rows[:30])
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
