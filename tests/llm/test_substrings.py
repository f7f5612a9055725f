import hashlib
import random
import re

import numpy as np
import pytest

from cyclecast.llm import common, substrings


def slow(rows, size):
    """Per row: words, and which are gone."""
    words = [re.findall("[^\x20\x09-\x0d]+", t) if t else [] for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1 if d is not None else 0):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((w, gone))
    return out


def runs(gone):
    return [m.span() for m in re.finditer("1+", "".join("01"[g] for g in gone))]


def corpus(seed, size):
    """Passages, copies and copies with edits among words of a small alphabet."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "é", "中文", "d" * 9, "Ab", "x.", "\x85", " q"])
    pool = [[word() for _ in range(rnd.randint(size // 2, 4 * size))] for _ in range(12)] + [["a"] * 3 * size, ["a", "b"] * 2 * size]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randint(0, 4)):
            part = list(rnd.choice(pool)) if rnd.random() < 0.7 else [word() for _ in range(size)]
            for _ in range(rnd.choice([0, 0, 1, 2])):
                part[rnd.randrange(len(part))] = word()
            at = rnd.randrange(len(part))
            w += part[at:] + part[:at] if rnd.random() < 0.3 else part
        rows.append((rnd.randrange(-50, 10_000), "".join(x + rnd.choice([" ", "\n", "\t ", "\x0b\x0c\r"]) for x in w)))
    return rows


@pytest.mark.parametrize("size", [2, 7, 50])
def test_matches_brute_force(spark, size):
    common.prepare(spark)
    rows = corpus(size, size)
    rows += [(None, rows[3][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[4][1]), (20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one two")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, kept string, _id int, crc int").repartition(5)
    found = substrings.dedup(docs, size)
    assert found.columns == [*docs.columns, "repeats", "n_words", "n_removed", "_kept"]
    got = sorted((str((r.doc_id, r.text)), r.n_words, r.n_removed, r._kept, [(x.begin, x.end) for x in r.repeats or ()]) for r in found.collect())
    want = [(str(r), len(w), sum(g), None if r[1] is None else " ".join(x for x, y in zip(w, g) if not y), runs(g)) for r, (w, g) in zip(rows, slow(rows, size))]
    assert got == sorted(want) and sum(x[2] for x in want) > 500


def test_very_long_text_hot_passage_and_empty_table(spark):
    common.prepare(spark)
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{rnd.randrange(9)}" for _ in range(300_000))
    rows = [(1, long), (2, f"start {long} end"), (3, " ".join(["same"] * 100_000)), (4, "x " + " ".join(["same"] * 60))]
    rows += [(10 + i, f"{' '.join(f'u{rnd.random()}' for _ in range(20))} {passage} {' '.join(f'v{rnd.random()}' for _ in range(20))}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_repeats) for r in substrings.report(docs).collect()}
    assert got[1] == (300_000, 0, 0) and got[2] == (300_002, 300_000, 1) and got[3] == (100_000, 0, 0) and got[4] == (61, 60, 1)
    assert got[10] == (100, 0, 0) and all(got[10 + i] == (100, 60, 1) for i in range(1, 600))
    assert substrings.report(docs.limit(0)).collect() == []


def test_no_words_empty_digest(spark):
    got = substrings.report(spark.createDataFrame([(1, None), (2, " \t")], "doc_id long, text string")).collect()
    assert {r.kept_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and all(r.n_words == r.n_removed == 0 for r in got)


def test_each_window_has_one_anchor(monkeypatch):
    monkeypatch.setattr(substrings, "STEP", 1000)
    rnd = random.Random(1)
    sizes = [(50, 4), (51, 9), (0, 1), (400, 2), (2500, 3), (49, 1), (2500, 10**6), (1200, 1), (1, 1), (60, 60)]
    made = [" ".join(f"w{rnd.randrange(words)}" for _ in range(n)).encode() for n, words in sizes]
    for size in (50, 2, 3):
        texts = substrings.Texts(made)
        assert texts.joined.split() == b" ".join(made).split() and len(texts.owner) == sum(n for n, _ in sizes)
        key, first, last = substrings.anchors(texts, size)
        windows = [s for s in range(len(texts.owner) - size + 1) if texts.owner[s] == texts.owner[s + size - 1]]
        assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]).tolist() == windows
        k = max(1, size // 2)
        h = substrings.word_hashes(texts.joined, texts.begins[:-1], texts.begins[1:] - 1)
        keys = np.concatenate([substrings.rolling(h[a : a + k], k) for a in range(len(h) - k + 1)])
        for x, a, b in zip(key.view(np.uint64), first, last):
            assert all(keys[s : s + size - k + 1].min() == x for s in (a, b))


def test_word_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"abcdefgh", b"abcdefghi", b"abcdefgh" * 2, b"x" * 9, b"x" * 10, b"x" * 40, b"x", b"\x00", b"\x00\x00", "é".encode()]
    hashes = lambda t: substrings.word_hashes(t.joined, t.begins[:-1], t.begins[1:] - 1)
    for order in (words, words[::-1]):
        found = hashes(substrings.Texts([b" \n".join(order)])).tolist()
        assert len(set(found)) == len(words) and found == [int(hashes(substrings.Texts([w]))[0]) for w in order]
