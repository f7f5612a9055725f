import hashlib
import random
import time

from cyclecast.llm import common, linededup


def distance_at_most_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def slow(rows, chars=linededup.MIN_EDIT_CHARS):
    places = sorted((d, i, line.strip()) for d, t in rows if d is not None and t for i, line in enumerate(t.split("\n")) if line.strip())
    gone = {}
    for d, i, line in places:
        first = next(((e, j) for e, j, other in places if (e, j) < (d, i) and (line == other or min(len(line), len(other)) >= chars and distance_at_most_one(line, other))), None)
        if first:
            gone[d, i] = first
    return gone


def edit(line, rnd):
    at, kind = rnd.randrange(len(line)), rnd.randrange(3)
    return line[:at] + [rnd.choice("abé中"), "", rnd.choice("xyz") + line[at]][kind] + line[at + 1 :]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices("abcdé ", k=rnd.randint(15, 80))) for _ in range(60)] + ["a" * 30, "a" * 31, "a" * 32, "ab" * 16, "ab" * 16 + "a"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randint(0, 8)):
            line = rnd.choice(pool) if rnd.random() < 0.7 else "".join(rnd.choices("abcdefg ", k=40))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                line = edit(line, rnd) or line
            lines.append(rnd.choice(["", " "]) + line + rnd.choice(["", "\r"]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_matches_brute_force(spark):
    common.prepare(spark)
    for seed in (1, 2):
        rows = [*corpus(seed), (500, None), (501, ""), (502, "\n\n"), (503, "z" * 30000 + "\nshort")]
        docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, dropped string, _gone int, _id int, h1 int").repartition(4)
        gone = slow(rows)
        assert len(gone) > 40
        got = {(r.doc_id, x.line): (x.first_doc_id, x.first_line) for r in linededup.dropped_lines(docs).collect() for x in r.dropped}
        assert got == gone
        out = linededup.dedup(docs)
        assert out.columns == [*docs.columns, "_dropped"]
        for r in out.collect():
            text = dict(rows)[r.doc_id]
            want = text if text is None or r._dropped is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (r.doc_id, i) not in gone)
            assert r.text == want


def test_exact_only_and_full_bitmap(spark, monkeypatch):
    common.prepare(spark)
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string")
    seen, gone = set(), set()
    for d, t in corpus(3):
        for i, line in enumerate(t.split("\n")):
            if line.strip():
                (gone if line.strip() in seen else seen).add((d, i) if line.strip() in seen else line.strip())
    assert {(r.doc_id, x.line) for r in linededup.dropped_lines(docs, 0).collect() for x in r.dropped} == gone
    monkeypatch.setattr(common, "BITMAP_LEAST", 6)
    monkeypatch.setattr(common, "BITMAP_MOST", 6)
    assert {(r.doc_id, x.line) for r in linededup.dropped_lines(docs, 1).collect() for x in r.dropped} == set(slow(corpus(3)))


def test_repeated_rows_empty_table_and_stage(spark):
    common.prepare(spark)
    line = "this line is long enough to count"
    assert linededup.dropped_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, line, 33), (1, line, 33), (1, line, 33), (2, f"{line}\nnew words of another long line", 64), (3, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in linededup.keep_new_lines(docs).collect())
    assert got == [("2", "new words of another long line", 30), ("3", "short", 5), ("None", line, 33)]
    assert linededup.dedup(docs.limit(0)).count() == 0
    rep = {r.doc_id: r for r in linededup.report(docs.where("doc_id > 1")).collect()}
    assert rep[2].n_dropped == 0 and rep[3].kept_sha256 == hashlib.sha256(b"short").hexdigest()


def test_very_common_line_and_other_bounds(spark, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [*corpus(5), *((1000 + i, f"a very common line of its own\nline number {i * 7919}\nYes.") for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for chars in (5, 40):
        got = {(r.doc_id, x.line): (x.first_doc_id, x.first_line) for r in linededup.dropped_lines(docs, 1, chars).collect() for x in r.dropped}
        assert got == slow(rows, chars)


def test_a_text_of_many_lines_costs_its_lines(spark):
    common.prepare(spark)
    lines = [f"line {i} of a long text, with some words" for i in range(100_000)] + ["same"] * 100_000
    texts = ["\n".join(lines), "\n".join(lines[::2] + ["new at the end of the text"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: (r.text, len(r.dropped)) for r in linededup.dedup(docs, max_edits=0).collect()}
    assert got == {0: ("\n".join(lines[:100_001]), 99_999), 1: ("new at the end of the text", 100_000)}
    assert time.monotonic() - began < 120
