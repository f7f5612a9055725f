import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from cyclecast.llm import bpe, common
from tests.llm.test_linededup import distance_at_most_one, edit
from tests.llm.test_pii import slow_spans, slow_terms

WORDS = {"en": "the thing with over water and that shore near hill".split(), "fr": "le eau chose avec dans rivage elle dont mont sous".split()}


def corpus(seed=5):
    rnd = random.Random(seed)
    rows = []

    def line(lang, n):
        return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(WORDS[lang]) + rnd.choice(WORDS[lang]) for _ in range(n))

    for i in range(90):
        lang = rnd.choice(["en", "fr"])
        rows.append([i, "\n".join(line(lang, rnd.randint(20, 60)) for _ in range(rnd.randint(2, 5))), lang])
    boiler = line("en", 12)
    for i in range(0, 60, 6):
        rows[i][1] += "\n" + (boiler if i % 4 else edit(boiler, rnd))
    for i in range(1, 60, 20):  # too few for terms to disclose them; test_pii has those
        rows[i][1] += f"\nwrite to user{i}@mail.example.com or +1 (706) 555-31{i:02d}"
    rows += [[100 + i, rows[i * 3][1], rows[i * 3][2]] for i in range(8)]  # copies
    for i in range(8):  # a few words of a long text changed
        text = rows[60 + i][1].replace("\n", " ").split()
        rows.append([200 + 2 * i, " ".join(text * 2), rows[60 + i][2]])
        text = text * 2
        text[7] = "changed"
        rows.append([201 + 2 * i, " ".join(text), rows[60 + i][2]])
    rows += [[300, None, "en"], [301, "", "fr"], [302, "123 456 -- 789", "en"], [303, "あい" * 200, None]]
    return rows


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    kept = [(d, t) for d, t, _ in rows if t and any(map(str.isalpha, t)) and "あ" not in t]
    seen, out = [], []
    for d, t in sorted(kept):
        left = []
        for x in t.split("\n"):
            x = x.strip()
            if not x or not any(x == y or min(len(x), len(y)) >= 10 and distance_at_most_one(x, y) for y in seen):
                left.append(x)
            if x:
                seen.append(x)
        if left == t.split("\n") or "\n".join(left).strip():
            out.append((d, "\n".join(left)))
    firsts = []
    for d, t in out:
        s = shingles(t)
        if not any(len(s & o) >= 0.8 * len(s | o) for _, _, o in firsts):
            firsts.append((d, t, s))
    assert not slow_terms([(d, t) for d, t, _ in firsts])
    masked = {}
    for d, t, _ in firsts:
        for kind, a, b in sorted(slow_spans(t), key=lambda x: -x[1]):
            t = t[:a] + f"<{kind.upper()}>" + t[b:]
        masked[d] = t
    return masked


def test_pipeline_matches_brute_force(spark, tmp_path):
    common.prepare(spark)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows)
    assert len(want) < len(rows) - 15
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for d, text in want.items():
        ids, at = [*encoder.encode_ordinary(text), 0], 0
        for p in sorted(got[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids), (d, text)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "the water and that shore over the hill", "en", "s", 38, "x")], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"water{i} shore" for i in range(40_000))
    rows = [(1, "the water and that shore over the hill", "en", "s", 38), (1, "the water and that shore over the hill", "en", "s", 38), (2, None, None, None, None), (None, "the water over that shore", None, "s", None), (3, "", "en", "s", 0), (4, long, "en", None, len(long)), (5, "le mont sous eau", "fr", "s", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id) for r in df.collect())
    everything = ids(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = ids(stage(spark, docs, ""))
        want = everything
        if name == "language":
            want = [x for x in want if x[1] not in (2, 3)]
        assert left == want, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, None} and sum(r.start == 0 for r in packed) == len(rows)
