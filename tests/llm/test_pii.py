import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from cyclecast.llm import common, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = 0
                for i, d in enumerate(reversed(digits)):
                    d = int(d) * (1 + i % 2)
                    total += d - 9 if d > 9 else d
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    bits = ["a", "é", "@", ".", "-", "x.y", "1", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+", "(", ")", " ", "+1 (706) 555-3138", "me@a.b", "10.0.0.1", "%", "_", "00000001"]
    hits = Counter()
    for _ in range(6000):
        text = "".join(rnd.choices(bits, k=rnd.randint(1, 25)))
        assert pii.base_spans(text) == slow_spans(text)
        hits.update(k for k, _, _ in pii.base_spans(text))
    assert min(hits[k] for k in pii.KINDS) > 50


def test_long_runs_take_linear_time():
    for text in ("a" * 10**6, "a" * 10**6 + "@", "1" * 10**6, "1." * 10**5, "+1" + "(" * 10**5, "@" * 10**5, "a@b." * 10**5):
        pii.base_spans(text)


def corpus(n=300):
    rnd = random.Random(7)
    vocab = ["w" + "".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.choice([60, 200]))
        if i % 4 == 0:  # a person, whose name stands with the address, in other case, and far from it
            person = i // 4 % 15
            words[30:31] = [f"NÄME{chr(97 + person)}x", "said", "write", f"user{person}@{'Mail' if i % 8 else 'mail'}.example.com"]
            words += [f"Näme{chr(97 + person)}x"]
        if i % 7 == 0:
            words[10:11] = ["reach", f"10.0.{i % 5}.7"]
        if i % 5 == 0:
            words[50] = "reach"
        if i % 50 == 3:
            words[5:6] = [f"once{chr(97 + i // 50)}", f"only{i}@a.example.org"]
        rows.append((i, " ".join(words)))
    return [*rows, (900, None), (901, ""), (902, "é mail a@b.cd"), (None, rows[0][1]), (0, rows[0][1]), (903, "copied text of z@y.example.com"), (904, "copied text of z@y.example.com")]


def slow_terms(rows):
    """By row: the places of terms, from sets of documents."""
    entity_rows, near_rows, near_docs, term_rows, places = (defaultdict(set) for _ in range(5))
    for row, (doc_id, text) in enumerate(rows):
        text = text or ""
        spans = slow_spans(text)
        all_words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        for _, _, w in all_words:
            term_rows[w].add(row)
        words = [(a, b, w) for a, b, w in all_words if all(b <= s or e <= a for _, s, e in spans)]
        for a, b, w in words:
            places[row, w].add((a, b))
        for kind, start, end in spans:
            e = (kind, text[start:end].lower())
            entity_rows[e].add(row)
            before = [w for a, _, w in words if a < start][-50:]
            for w in before + [w for a, _, w in words if a > start][:50]:
                near_rows[e, w].add(row)
                near_docs[e, w].add((doc_id, text))
    found = defaultdict(set)
    for (e, w), with_both in near_rows.items():
        if len(near_docs[e, w]) > 1 and len(entity_rows[e]) < len(rows):
            base = len(entity_rows[e]) / len(rows)
            if math.log2(len(with_both) / len(term_rows[w]) / base) / -math.log2(base) >= 0.9:
                for row in with_both:
                    found[row] |= places[row, w]
    return found


def test_report_matches_brute_force(spark, monkeypatch):
    common.prepare(spark)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int").repartition(3)
    terms = slow_terms(rows)
    words = {rows[row][1][a:b].lower() for row, places in terms.items() for a, b in places}
    assert {f"näme{chr(97 + p)}x" for p in range(15)} <= words and not words & {"said", "write", "reach", "oncea"} and "copied" in words
    want = []
    for row, (i, text) in enumerate(rows):
        base = slow_spans(text or "")
        show = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        told = [("term", a, b) for a, b in sorted(terms[row])]
        want.append((i, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), hashlib.sha256(show(base).encode()).hexdigest(), show(base + told)))
    assert Counter(map(tuple, pii.report(docs).collect())) == Counter(want)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    monkeypatch.setattr(common, "BITMAP_LEAST", 6)
    monkeypatch.setattr(common, "BITMAP_MOST", 6)
    assert Counter(map(tuple, pii.report(docs).collect())) == Counter(want)
    assert pii.report(docs.limit(0)).count() == 0
    assert pii.report(docs.where("doc_id = 902")).first().spans == "email:7:13"


def test_terms_come_out_of_a_table_of_documents(spark):
    common.prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(rows[row][0], ",".join(f"term:{a}:{b}" for a, b in sorted(places))) for row, places in slow_terms(rows).items() if places}
    got = {(r.doc_id, r.spans[r.spans.index("term:") :]) for r in pii.report(docs).where("spans like '%term:%'").collect()}
    assert got == want and len(want) > 2


def test_sanitise_masks_and_keeps_rows(spark):
    common.prepare(spark)
    rows = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in rows], "doc_id long, text string, n_chars long, k1 string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert "@" not in "".join(r.text or "" for r in got) and "näme" not in "".join(r.text or "" for r in got).lower()
    assert "<EMAIL>" in by_id[0].text and "<IP>" in by_id[7].text and by_id[900].text is None
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert by_id[1].text == rows[1][1]


def test_overlapping_spans_are_masked_once():
    spans = [dict(kind="card", start=2, end=9), dict(kind="phone", start=1, end=6)]
    assert pii.mask("x+123456789y", spans, [dict(start=11, end=12, disclosure=0.95)]) == "x<PHONE>89<TERM>"
