import hashlib
import random
import re

from cyclecast.llm import common, fim


def slow(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def corpus():
    rnd = random.Random(3)
    pieces = ["a", "Zed", " ", "é", "中", "😀", "\n", "\r", "\0", "<", "P", "S", "M", ">", "'", "\\", "1", "é", "<P", "S>"]
    rows = [(i, "".join(rnd.choices(pieces, k=rnd.randint(0, 40)))) for i in range(1500)]
    rows += [(7, rows[7][1])] * 3 + [(7, "another text"), (None, "no id at all"), (2000, None), (2001, ""), (2002, "x <M> y"), (2003, "<P>"), (2004, "word é " * 200_000), (-5, "negative id")]
    return rows


def test_matches_brute_force_and_restores(spark):
    common.prepare(spark)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", {"a": [1.5]}, 3) for r in rows], "doc_id long, text string, output string, form map<string, array<double>>, batch int").repartition(3)
    made = fim.transform(docs)
    assert made.columns == [*docs.columns, "n", "_form", "prefix_chars", "middle_chars", "_output"]
    got = fim.restore(made, "_output", "_form").collect()
    assert len(got) == len(rows) and {r._form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r._form, r.prefix_chars, r.middle_chars, r._output) == slow(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.output == "x" and r.form == {"a": [1.5]}


def test_settings(spark):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(200)], "doc_id long, text string")
    for seed, plain, spm in ((2, 0, 100), (1, 100, 0), (9, 30, 50)):
        for r in fim.transform(docs, seed=seed, plain_percent=plain, spm_percent=spm).collect():
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow(r.doc_id, r.text, seed, plain, spm)


def test_report_and_empty_table(spark):
    common.prepare(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = corpus()[1400:]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(2)
    found = fim.report(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = sorted(((d, *(w := slow(d, t))[:4], sha(w[4]), sha(t or "")) for d, t in rows), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert fim.report(docs.limit(0)).collect() == [] and fim.restore(fim.transform(docs.limit(0))).collect() == []
