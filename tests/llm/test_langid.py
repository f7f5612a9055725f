import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cyclecast.llm import common, langid

WORDS = {
    "en": ["the", "thing", "with", "over", "water", "and", "that", "shore"],
    "fr": ["le", "être", "eau", "chose", "avec", "dans", "élève", "rivage"],
    "de": ["der", "über", "wasser", "ding", "nicht", "schön", "ufer", "straße"],
}


def rows(n=240, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(3, 60))).capitalize() + ".", lang, f"s{i % 3}"))
    return out


def model_of(texts):
    counts = defaultdict(Counter)
    for _, text, lang, _ in texts:
        for word in text.lower().split():
            counts[lang].update(langid.grams_of(word))
    alphabet = len({g for c in counts.values() for g in c if len(g) == 1})
    models = {lang: [[langid.arrays(level) for level in kind] for kind in langid.estimate(own, alphabet)] for lang, own in counts.items()}
    model = langid.assemble(models, alphabet)
    model.limits = [9.0] * len(counts)
    return model, counts


class SlowKneserNey:
    """One language by the textbook: occurrences of strings in padded words, no tables."""

    def __init__(self, words, alphabet):
        self.padded, self.alphabet = [f"\x02{w}\x02" for w in words], alphabet
        self.all = {p[a:b] for p in self.padded for a in range(len(p)) for b in range(max(a + 1, 2), min(len(p), a + langid.ORDER) + 1)}

    def occurs(self, gram):
        return sum(p[i:].startswith(gram) for p in self.padded for i in range(0 if len(gram) > 1 else 1, len(p)))

    def count(self, gram):
        if len(gram) == langid.ORDER or len(gram) > 1 and gram[0] == "\x02":
            return self.occurs(gram)
        return len({p[i - 1] for p in self.padded for i in range(1, len(p)) if p[i:].startswith(gram)})

    def of(self, char, before):
        below = self.of(char, before[1:]) if before else 1 / (self.alphabet + 1)
        followers = {g[-1] for g in self.all if g[:-1] == before}
        if not followers:
            return below
        counts = [self.count(g) for g in self.all if len(g) == len(before) + 1]
        once, twice = counts.count(1), counts.count(2)
        d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        total = sum(self.count(before + c) for c in followers)
        return max(self.count(before + char) - d, 0) / total * (char in followers) + d * len(followers) / total * below


def test_probabilities_are_those_of_kneser_ney():
    texts = rows(24)
    model, counts = model_of(texts)
    alphabet = len({g for c in counts.values() for g in c if len(g) == 1})
    slow = {lang: SlowKneserNey([w for _, t, own, _ in texts if own == lang for w in t.lower().split()], alphabet) for lang in model.langs}
    for text in ("\x02t", "\x02th", "\x02the", "\x02thei", "ater\x02", "über", "sser", "zzzz", "xwat", "éq", "q", "\x02q", "eau\x02", "th\x02"):
        want = [np.log(slow[lang].of(text[-1], text[:-1][-langid.ORDER + 1 :])) for lang in model.langs]
        assert np.allclose(model.last(text), want), text


def test_probabilities_sum_to_one():
    model, counts = model_of(rows())
    letters = {g for c in counts.values() for g in c if len(g) == 1}
    for context in ("\x02", "\x02w", "wa", "über", "zzz", "the", "ît"):
        total = sum(np.exp(model.last(context + c)) for c in letters) + np.exp(model.last(context + "\x7f"))
        assert np.allclose(total, 1)


@pytest.mark.parametrize("most", [langid.MAX_BYTES, 100])
def test_scorer_adds_up_character_by_character(monkeypatch, most):
    monkeypatch.setattr(langid, "MAX_BYTES", most)
    model, _ = model_of(rows())
    scorer = langid.Scorer(model)
    text = "The wasser être unknown42 the " + "x" * 5000 + " ".join(f" w{i}" for i in range(3000))
    total, size = np.zeros(3), 0
    for word in text.lower().split():
        w = "\x02" + word + "\x02"
        for end in range(2, len(w) + 1):
            total += model.last(w[max(0, end - langid.ORDER) : end])
            size += 1
    lang, score, entropy, _ = scorer.judge(text)
    assert abs(entropy - (-total / size).min()) < 1e-9 and lang == model.langs[int((-total / size).argmin())]
    assert 0 <= score <= 1
    again = scorer.judge(text)
    assert abs(again[2] - entropy) < 1e-12


def test_held_out_accuracy_and_odd_rows(spark):
    common.prepare(spark)
    data = [*rows(), (1000, None, "en", "s"), (1001, "", "fr", "s"), (1002, "123 -- 456", "de", "s"), (1003, "Der schöne wasser", None, "s"), (None, "the water", "en", "s"), (1004, "the water " * 20000, "en", "s")]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, source string, score string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(data)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    right = [got[i].lang_pred == lang for i, _, lang, _ in rows() if got[i].held_out]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {i for i, *_ in data} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


def test_nothing_to_learn(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]
    assert langid.identify(docs.limit(0)).count() == 0


def test_rejects_what_no_model_explains():
    model, _ = model_of(rows())
    model.limits = [2.0] * 3
    scorer = langid.Scorer(model)
    assert scorer.judge("qxzj kvqw " * 20)[3] and not scorer.judge("the water over that shore and the thing")[3]


def test_rare_languages_reject_and_are_learnt(spark, monkeypatch):
    common.prepare(spark)
    few = [(2000, "zq", "xx"), *((3000 + i, "kot pies dom woda las " * 4, f"r{i}") for i in range(12))]
    docs = spark.createDataFrame([*((i, t, lang) for i, t, lang, _ in rows()), *few], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert {*WORDS, "xx", *(f"r{i}" for i in range(12))} == set(model.langs)  # a single text is learnt from
    assert np.isfinite(model.limits).all()
    noise = spark.createDataFrame([("".join(random.Random(5).choices("bcdfghjkmnpqvxz", k=300)),)], "text string")
    assert langid.predict(noise, model).first().rejected
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 100)  # few long texts are learnt from in part, never left out
    assert set(langid.learn(docs).langs) == set(model.langs)


def test_foreign_texts_and_noise_are_rejected(spark):
    """Models of the table's four languages: texts of others, and no texts, go; the table's stay."""
    common.prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rnd = langid.learn(docs.where(~langid.is_held_out())), random.Random(4)
    other = [
        "człowiek który jest bardzo dobry dla wszystkich ludzi na świecie i nigdy nie zapomina o swoich przyjaciołach",
        "это просто текст на русском языке для проверки модели и ничего больше",
        "bu cümle modelin bilmediği bir dilde yazılmıştır ve kabul edilmemelidir çünkü yabancıdır",
        "kun jälleen tuli kevät ja lumi suli pois niin lapset lähtivät järven rannalle leikkimään",
        "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz    ", k=300)),
        "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=300)),
        "def run(x): return {k: v for k, v in x.items() if v != 0}\nimport os, sys\n" * 3,
    ]
    found = langid.predict(spark.createDataFrame([(t,) for t in other], "text string"), model).collect()
    assert [r.rejected for r in found] == [True] * len(other)
    kept = langid.predict(docs.where(langid.is_held_out()), model, columns=("lang_pred", "rejected")).where("text rlike '[A-Za-z]'")
    assert kept.where("rejected").count() == 0 and kept.where("lang_pred <> lang").count() <= 0.01 * kept.count()


@pytest.mark.parametrize("few", [langid.FEW_LANGS, 1])
def test_repeated_rows_and_null_ids_dont_fill_the_sample(spark, monkeypatch, few):
    common.prepare(spark)
    monkeypatch.setattr(langid, "FEW_LANGS", few)
    texts = [*[(None, "the water over that shore", "en")] * 3000, *((i, f"thing {i}", "en") for i in range(900)), (None, "der schöne", "de"), *[(7, "le même", "fr")] * 2000]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in langid.sample(docs).collect())
    assert got == {"en": langid.SAMPLE_DOCS, "de": 1, "fr": 1}
