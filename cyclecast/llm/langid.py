"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of the characters of a word, given those before
them in the word. A model is arrays sorted by the n-grams' hashes: log probabilities of the n-grams it
has seen, and back-off weights of their contexts. They lie together, a hash's languages side by side,
so what a language hasn't seen takes no room. A text gets the language with the lowest cross-entropy
per character (of equal ones the first by name); a threshold calibrated on labelled texts rejects what
no model explains.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.llm.common import fresh, kept, map_batches

#: Characters of a context are at most one less.
ORDER = 5
#: Labelled texts to learn from: of each language at most so many different ones, chosen by hash, with
#: about so many characters; of all languages together about so many. These bound the models' size.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 400, 1_000_000, 64_000_000
#: So many languages' counts may be broadcast.
FEW_LANGS = 100_000
#: Of a language's sampled texts each so many-th only calibrates the rejection; fewer texts are all
#: learnt from.
HELD = 5
#: Rejected: cross-entropy over ``SLACK`` times the calibration texts' quantile ``QUANTILE``, in texts
#: of at least ``LETTERS`` letters.
QUANTILE, SLACK, LETTERS = 0.999, 1.6, 20
#: Words that a worker remembers the scores of, and bytes of these at most.
MAX_WORDS, MAX_BYTES = 100_000, 64 << 20
EDGE = "\x02"


def _hash(gram: str) -> int:
    """64 bits of FNV-1a over code points; the same in every process."""
    h = 0xCBF29CE484222325
    for c in gram:
        h = (h ^ ord(c)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Table:
    """A sorted hash array: values of the n-grams of one length in those languages that have them."""

    hashes: np.ndarray
    starts: np.ndarray  # where each hash's languages begin, and the end
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Table:
        """From (language, hashes, values)."""
        hashes = np.concatenate([np.empty(0, np.uint64), *(h for _, h, _ in parts)])
        langs = np.concatenate([np.empty(0, np.int32), *(np.full(len(h), i, np.int32) for i, h, _ in parts)])
        order = np.lexsort((langs, hashes))
        found, starts = np.unique(hashes[order], return_index=True)
        return cls(found, np.append(starts, len(order)), langs[order], np.concatenate([np.empty(0), *(v for *_, v in parts)])[order])

    def get(self, gram: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The languages that have it, and their values."""
        h = _hash(gram)
        i = int(np.searchsorted(self.hashes, np.uint64(h)))
        if i == len(self.hashes) or self.hashes[i] != h:
            return None
        at = slice(self.starts[i], self.starts[i + 1])
        return self.langs[at], self.values[at]


@dataclass
class Model:
    langs: list[str]
    probs: list[Table]  # by length less one: interpolated log probabilities
    backs: list[Table]  # by length of the context: log weights of what the shorter one says
    unseen: float  # log probability of a character that no text had
    limits: list[float]

    def last(self, text: str) -> np.ndarray:
        """Log probability, in each language, of the last character of ``text`` after those before it."""
        total, open_ = np.zeros(len(self.langs)), np.ones(len(self.langs), bool)
        for n in range(min(ORDER, len(text)), 0, -1):
            for table, gram in ((self.probs[n - 1], text[-n:]), (self.backs[n - 1], text[-n:-1])):
                found = table.get(gram)
                if found:
                    langs, values = found
                    asked = open_[langs]
                    total[langs[asked]] += values[asked]
                    if table is self.probs[n - 1]:
                        open_[langs] = False
            if not open_.any():
                return total
        total[open_] += self.unseen
        return total


def grams_of(word: str) -> Iterator[str]:
    """The n-grams that end at each character of the word or at its end."""
    text = EDGE + word + EDGE
    for at in range(1, len(text)):
        for n in range(1, min(ORDER, at + 1) + 1):
            yield text[at - n + 1 : at + 1]


def estimate(own: dict[str, int], alphabet: int) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """The interpolated Kneser-Ney model of one language's n-gram counts: by length less one, the log
    probabilities of the n-grams and the log back-off weights of the contexts.

    The longest n-grams, and those at a word's start (nothing can stand before them), count as often
    as they occur; all others as often as they continue different characters. Discount of order n:
    n1 / (n1 + 2 n2). ``alphabet``: characters of all languages; one more stands for those unseen.
    """
    adjusted: dict[str, int] = defaultdict(int)
    for gram, n in own.items():
        if len(gram) == ORDER or gram[0] == EDGE and len(gram) > 1:
            adjusted[gram] += n
        if len(gram) > 1:
            adjusted[gram[1:]] += 1
    levels: list[dict[str, int]] = [{} for _ in range(ORDER)]
    for gram, n in adjusted.items():
        levels[len(gram) - 1][gram] = n
    prob: dict[str, float] = {}
    probs, backs = [], []
    for level in levels:
        kinds = Counter(level.values())
        discount = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0.5
        discount = min(max(discount, 0.1), 0.9)
        total, types = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        back = {context: discount * types[context] / n for context, n in total.items()}
        new = {}
        for g, c in level.items():
            low = prob[g[1:]] if len(g) > 1 else 1 / (alphabet + 1)
            new[g] = max(c - discount, 0) / total[g[:-1]] + back[g[:-1]] * low
        probs.append({g: log(p) for g, p in new.items()})
        backs.append({c: log(w) for c, w in back.items()})
        prob = new
    return probs, backs


def assemble(models: dict[str, tuple[list, list]], alphabet: int) -> Model:
    """One model of the languages' own: by length less one, (hashes, values) of n-grams and of contexts."""
    langs = sorted(models)
    tables = [[Table.of([(i, *models[lang][kind][n]) for i, lang in enumerate(langs)]) for n in range(ORDER)] for kind in (0, 1)]
    return Model(langs, *tables, float(-np.log(alphabet + 1)), [])


def arrays(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([_hash(g) for g in values], np.uint64), np.array(list(values.values()), float)


_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


class Scorer:
    """Scores whole texts. What a word adds is computed once as long as a worker remembers it, and for
    all new words of a batch at a time."""

    def __init__(self, model: Model):
        self.model, width = model, max(1, len(model.langs))
        self.most = max(1000, min(MAX_WORDS, MAX_BYTES // (8 * width)))
        self.step = max(64, MAX_BYTES // (32 * width))  # characters at once
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))
        self.grams, self.gram_rows = np.empty(0, np.uint64), self.rows

    def _add(self, total: np.ndarray, open_: np.ndarray, at: np.ndarray, hashes: np.ndarray, table: Table, closes: bool) -> None:
        """Adds what ``table`` has of the hashes to the places ``at``, in the languages open there."""
        if not len(table.hashes):
            return
        i = np.minimum(np.searchsorted(table.hashes, hashes), len(table.hashes) - 1)
        met = table.hashes[i] == hashes
        at, i = at[met], i[met]
        n = table.starts[i + 1] - table.starts[i]
        flat = np.arange(n.sum()) + np.repeat(table.starts[i] - (np.cumsum(n) - n), n)
        row, lang = np.repeat(at, n), table.langs[flat]
        asked = open_[row, lang]
        row, lang = row[asked], lang[asked]
        total[row, lang] += table.values[flat[asked]]
        if closes:
            open_[row, lang] = False

    def _score_grams(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``Model.last`` of the grams: rows of code points, the last ``sizes`` of each row."""
        model = self.model
        total, open_ = np.zeros((len(grams), len(model.langs))), np.ones((len(grams), len(model.langs)), bool)
        with np.errstate(over="ignore"):
            for n in range(ORDER, 0, -1):
                at = np.flatnonzero(sizes >= n)
                context = np.full(len(at), _BASIS)
                for j in range(ORDER - n, ORDER - 1):
                    context = (context ^ grams[at, j]) * _PRIME
                self._add(total, open_, at, (context ^ grams[at, -1]) * _PRIME, model.probs[n - 1], True)
                self._add(total, open_, at, context, model.backs[n - 1], False)
        total[open_] += model.unseen
        return total

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of the words in each language, their ends included.

        A character with those before it is looked up by one hash; what isn't remembered is scored first.
        """
        codes = np.frombuffer("".join([f"{EDGE}{w}{EDGE}" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        at = np.flatnonzero(place)  # a word's begin is given
        length = np.minimum(place[at] + 1, ORDER)
        keys = np.full(len(at), _BASIS)
        with np.errstate(over="ignore"):
            for back in range(ORDER - 1, -1, -1):
                inside = length > back
                keys[inside] = (keys[inside] ^ codes[at[inside] - back]) * _PRIME
        i = np.minimum(np.searchsorted(self.grams, keys), max(0, len(self.grams) - 1))
        new = self.grams[i] != keys if len(self.grams) else np.ones(len(keys), bool)
        if new.any():
            fresh_keys, first = np.unique(keys[new], return_index=True)
            first = np.flatnonzero(new)[first]
            windows = codes[np.maximum(at[first, None] - np.arange(ORDER - 1, -1, -1), 0)]
            if len(self.grams) + len(fresh_keys) > 4 * self.most:
                used = np.unique(i[~new])
                self.grams, self.gram_rows = self.grams[used], self.gram_rows[used]
            order = np.argsort(np.concatenate([self.grams, fresh_keys]), kind="stable")
            self.grams = np.concatenate([self.grams, fresh_keys])[order]
            self.gram_rows = np.concatenate([self.gram_rows, self._score_grams(windows, length[first])])[order]
            i = np.searchsorted(self.grams, keys)
        return np.add.reduceat(self.gram_rows[i], starts - np.arange(len(starts)), axis=0)

    def _learn(self, words: list[str]) -> None:
        found, begin, size = [self.rows[: len(self.known)]], 0, 0
        for end, word in enumerate(words):
            if size and size + len(word) > self.step:
                found.append(self.score_words(words[begin:end]))
                begin, size = end, 0
            size += len(word) + 2
        if words:
            found.append(self.score_words(words[begin:]))
        self.rows = np.concatenate(found)
        for word in words:
            self.known[word] = len(self.known)

    def _sums(self, parts: list[tuple[int, list[str]]], entropy: np.ndarray) -> None:
        """Takes each part's words from its text's row of ``entropy``."""
        new = {w for _, words in parts for w in words if w not in self.known}
        if len(self.known) + len(new) > self.most:
            self.known, self.rows = {}, self.rows[:0]
            new = {w for _, words in parts for w in words}
        if new:
            self._learn(list(new))
        known = self.known
        for i, words in parts:
            entropy[i] -= self.rows[[known[w] for w in words]].sum(axis=0)

    def judge_all(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy in nats per character, rejected, of each text."""
        model = self.model
        letters = [sum(1 for _ in islice(filter(str.isalpha, t or ""), LETTERS)) if model.langs else 0 for t in texts]
        entropy, sizes = np.zeros((len(texts), len(model.langs))), [0] * len(texts)
        parts, held = [], 0
        for i, text in enumerate(texts):
            if letters[i]:
                words = text.lower().split()
                sizes[i] = sum(map(len, words)) + len(words)
                for at in range(0, len(words), self.most):
                    part = words[at : at + self.most]
                    if held + len(part) > self.most and parts:
                        self._sums(parts, entropy)
                        parts, held = [], 0
                    parts.append((i, part))
                    held += len(part)
        if parts:
            self._sums(parts, entropy)
        out = []
        for own, size, n in zip(entropy, sizes, letters):
            if not n:
                out.append(("und", 0.0, None, True))
                continue
            own = own / size
            best = int(own.argmin())
            score = 1 / np.exp(-(own - own[best]) * min(size, 50)).sum()
            out.append((model.langs[best], float(score), float(own[best]), bool(n >= LETTERS and own[best] > model.limits[best])))
        return out

    def judge(self, text: str | None) -> tuple[str, float, float | None, bool]:
        return self.judge_all([text])[0]


def sample(docs: DataFrame) -> DataFrame:
    """``(lang, text, part)``: at most ``SAMPLE_DOCS`` different labelled texts of each language, by their
    hash, and all of a language with fewer. Copies are one."""
    hashed = docs.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("kinds")).checkpoint()
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_LANGS else sizes  # texts don't move for a few languages
    at = F.col("h").bitwiseAND(F.lit((1 << 40) - 1).cast("long")) / F.lit(float(1 << 40))
    few = hashed.join(sizes, "lang").where(at * F.col("kinds") < 1.2 * SAMPLE_DOCS)  # the count is approximate
    few = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(at, "h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("lang", "text", (F.col("rank") % HELD).alias("part"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of (lang, text)."""
    found: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[lang].update(text.lower().split())
    for lang, words in found.items():
        grams: Counter = Counter()
        for word, n in words.items():
            for gram in grams_of(word):
                grams[gram] += n
        names = list(grams)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array(names), pa.array([grams[g] for g in names], pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame) -> Model:
    """A model of each language in ``labelled(text, lang)``.

    The n-grams of the sample are counted in Spark and each language is estimated in a task of its own;
    the driver puts their arrays together, which ``SAMPLE_TOTAL`` bounds whatever the languages' number.
    Of a language with more characters than its share each text's first part is learnt from, in
    proportion to its length. Null texts and languages are not learnt from; with none left the model
    has no language. One text makes a language. Texts that get their own language calibrate its limit;
    where there are none, the limit is that of all languages' calibration texts together.
    """
    picked = sample(labelled.where("text is not null and lang is not null")).checkpoint()
    fit = picked.where(F.col("part") != 0)
    sizes = fit.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    most = min(SAMPLE_CHARS, SAMPLE_TOTAL // max(1, sizes.count()))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("chars", F.lit(1)))
    part = F.substring("text", F.lit(1), F.ceil(share * F.length("text")).cast("int"))
    counted = fit.join(sizes, "lang").select("lang", part.alias("text")).mapInArrow(_counts, "lang string, gram string, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    alphabet = counted.where(F.length("gram") == 1).select("gram").distinct().count()

    def own_arrays(table: pa.Table) -> pa.Table:
        counts = dict(zip(table.column("gram").to_pylist(), table.column("n").to_pylist()))
        found = [[x.tobytes() for pair in map(arrays, levels) for x in pair] for levels in estimate(counts, alphabet)]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()]), "packed": pa.array([found[0] + found[1]], pa.list_(pa.binary()))})

    models = {}
    for row in counted.groupBy("lang").applyInArrow(own_arrays, "lang string, packed array<binary>").toLocalIterator():
        pairs = [(np.frombuffer(h, np.uint64), np.frombuffer(v)) for h, v in zip(row.packed[::2], row.packed[1::2])]
        models[row.lang] = (pairs[:ORDER], pairs[ORDER:])
    model = assemble(models, alphabet)
    model.limits = [float("inf")] * len(model.langs)
    if model.langs:
        scored = predict(picked.where(F.col("part") == 0).select("lang", "text"), model, columns=("lang_pred", "entropy"))
        quantile = F.percentile("entropy", F.lit(QUANTILE)).alias("q")
        found = dict(scored.where("entropy is not null and lang_pred = lang").rollup("lang_pred").agg(quantile).collect())
        pooled = found.get(None)
        model.limits = [float("inf") if pooled is None else SLACK * found.get(lang, pooled) for lang in model.langs]
    return model


@kept
def _scorer(packed: bytes) -> Scorer:
    return Scorer(pickle.loads(packed))


def predict(docs: DataFrame, model: Model, text_col: str = "text", columns: tuple[str, ...] = ("lang_pred", "score", "entropy", "rejected")) -> DataFrame:
    """The columns of ``docs`` and these: language, score (0 to 1), cross-entropy, rejected.

    ``und`` (score 0, rejected) if the text is null or has no letter, or no language was learnt. Whole
    texts are read; nothing but the text decides, so repeated rows get the same, and of languages that
    explain it alike the first by name is told. An empty table gives no row. A name that ``docs`` has
    gets an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = [fresh(docs, c) for c in columns]
    types = {"lang_pred": "string", "score": "double", "entropy": "double", "rejected": "boolean"}

    @F.pandas_udf(", ".join(f"{c} {types[c]}" for c in types))
    def judge(texts):
        import pandas as pd

        scorer = _scorer(shared.value)
        return pd.DataFrame(scorer.judge_all(texts.to_list()), columns=list(types))

    at = fresh(docs, "_judged")
    return docs.withColumn(at, judge(F.col(text_col))).select(*docs.columns, *(F.col(at)[c].alias(n) for c, n in zip(columns, names)))


def is_held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's digits leaves 2 when divided by 4; such rows aren't learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, entropy, rejected."""
    labelled = docs.where(~is_held_out()).select("text", "lang")
    found = predict(docs.select("doc_id", is_held_out().alias("held_out"), "text"), learn(labelled))
    return found.drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those that the models reject or that have no letter (null and empty texts, too).

    Repeated rows stay or go together. If no text has a language, none stays. An empty table gives no row.
    """
    model = learn(docs.where(~is_held_out()).select("text", "lang"))
    rejected = fresh(docs, "rejected")
    return predict(docs, model, columns=("rejected",)).where(~F.col(rejected)).select(docs.columns)
