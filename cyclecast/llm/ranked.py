"""Ranked lexical search by block-max WAND with variable blocks.

The documents of an input partition are read shard by shard. A shard's posting lists (of the terms that
the queries ask) are cut into blocks whose borders a dynamic programme chooses, so that the blocks' maxima
overestimate the postings as little as possible. Borders of a query's blocks cut the shard into intervals
with one bound each; best bounds first, intervals are scored in full until no bound reaches the last of
the results. Nothing else is skipped, so the results are exact. Thresholds go on from shard to shard.

Texts stay where they are: a first pass counts documents, terms and document frequencies, a second one
searches, and only each partition's results are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of queries that are searched together and go to all tasks; of more there are several passes.
QUERY_BYTES = 16 << 20
#: Postings of a shard, in the memory of one task; the longest block; what a block costs, in gaps between
#: a list's greatest and mean posting; documents that are scored first.
SHARD_POSTINGS, LONGEST, PRICE, FIRST = 1 << 20, 64, 8, 1024
#: Parts of a query's results that are ranked apart first.
PARTS = 64
#: Bytes of a text that are split at once.
PIECE = 4 << 20

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_N, _L = -1, -2


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece: ASCII letters and digits and all else beyond ASCII, A-Z lower-cased."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _asked(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has, and the numbers and counts of those in the vocabulary."""
    n, found = 0, [np.empty(0, np.int32)]
    for piece in terms(text):
        ids = np.fromiter(map(vocabulary.get, piece, repeat(-1)), np.int32, len(piece))
        n += len(ids)
        found.append(ids[ids >= 0])
    return n, *np.unique(np.concatenate(found), return_counts=True)


def _statistics(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(term, n): the documents with each term of the vocabulary, those with a term at all (``_N``), all terms (``_L``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_term, total, df = 0, 0, np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                n, ids, _ = _asked(text.as_py(), vocabulary.value)
                with_term, total = with_term + (n > 0), total + n
                df[ids] += 1
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids, _N, _L].astype(np.int64)), pa.array(np.r_[df[ids], with_term, total])], ["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def block_starts(values: np.ndarray, ends: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Which of ``values`` begin a block. ``ends``: where each list of values ends, none of them empty.

    A partition into blocks of at most ``longest`` values costs what the blocks' maxima are above their
    values, and for each block ``price`` times the gap between its list's greatest and mean value. The
    dynamic programme finds the cheapest one, place by place in all lists at once.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - begins
    if not len(sizes):
        return np.zeros(0, bool)
    fixed = np.maximum(price * (np.maximum.reduceat(values, begins) - np.add.reduceat(values, begins) / sizes), 1)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes, fixed = begins[order], sizes[order], fixed[order]
    length = np.arange(1, longest + 1, dtype=float)
    cost = np.full((len(sizes), longest), np.inf)  # of the places before, nearest first
    cost[:, 0] = 0
    highest = np.full((len(sizes), longest), -np.inf)  # of the last values, one to longest
    taken = np.empty(len(values), np.int64)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for i, a in enumerate(active):
        x = values[begins[:a] + i].astype(float)
        if i:
            cost[:a, 1:] = cost[:a, :-1]
            cost[:a, 0] = now[:a]
        highest[:a, 1:] = highest[:a, :-1]
        highest[:a, 0] = -np.inf
        np.maximum(highest[:a], x[:, None], out=highest[:a])
        all_ = cost[:a] + highest[:a] * length
        best = all_.argmin(1)
        now = all_[np.arange(a), best] + fixed[:a]
        taken[begins[:a] + i] = best + 1
    starts = np.zeros(len(values), bool)
    at = begins + sizes
    while len(at):
        at = at - taken[at - 1]
        starts[at] = True
        more = at > begins
        at, begins = at[more], begins[more]
    return starts


class _Best:
    """The ``k`` best of a query so far: highest score, then smallest doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a score has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class _Shard:
    """Posting lists of some documents, at least one posting, in variable blocks. A posting is what its term adds to the score."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.doc_ids, term, tf = doc_ids, term[order], tf[order].astype(np.int64)
        self.doc = np.repeat(np.arange(len(doc_ids)), sizes)[order]
        self.value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        lists = np.flatnonzero(np.diff(term, append=-1)) + 1
        self.begin = np.flatnonzero(block_starts(self.value, lists))
        self.end = np.append(self.begin[1:], len(term))
        self.highest = np.maximum.reduceat(self.value, self.begin)
        self.first, self.last = self.doc[self.begin], self.doc[self.end - 1]
        owner = term[self.begin]
        self.low, self.high = (np.searchsorted(owner, np.arange(len(weight)), side) for side in ("left", "right"))

    def search(self, asked: np.ndarray, best: _Best) -> None:
        """Adds to ``best`` what the terms ``asked`` find here."""
        own = np.concatenate([np.arange(self.low[t], self.high[t]) for t in asked] or [np.empty(0, np.int64)])
        if not len(own):
            return
        # a bound between any two borders of blocks
        border = np.concatenate([self.first[own], self.last[own] + 1])
        step = np.concatenate([self.highest[own], -self.highest[own]])
        order = np.argsort(border, kind="stable")
        border, bound = border[order], np.cumsum(step[order])
        final = np.flatnonzero(np.diff(border, append=border[-1] + 1))
        low, high, bound = border[final][:-1], border[final][1:], bound[final][:-1]
        order = np.argsort(-bound, kind="stable")
        low, high, bound = low[order], high[order], bound[order]
        seen, chunk, covered = 0, FIRST, np.cumsum(high - low)
        while seen < len(bound) and bound[seen] >= best.least:
            to = max(seen + 1, int(np.searchsorted(covered, (covered[seen - 1] if seen else 0) + chunk, side="right")))
            to = min(to, int(np.searchsorted(-bound, -best.least, side="right")))
            self._score(own, low[seen:to], high[seen:to], best)
            seen, chunk = to, 2 * chunk

    def _score(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, best: _Best) -> None:
        """Scores the documents of some intervals; blocks that meet none of them are skipped."""
        edge = np.zeros(len(self.doc_ids) + 1, np.int64)
        edge[low] += 1
        np.subtract.at(edge, high, 1)
        inside = np.cumsum(edge)[:-1] > 0
        count = np.concatenate([[0], np.cumsum(inside)])
        own = own[count[self.last[own] + 1] > count[self.first[own]]]
        sizes = self.end[own] - self.begin[own]
        at = np.repeat(self.begin[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        at = at[inside[self.doc[at]]]
        score = np.zeros(len(self.doc_ids), np.int64)
        np.add.at(score, self.doc[at], self.value[at])
        found = np.flatnonzero(score >= best.least)
        best.add(score[found], self.doc_ids[found])


def _found(docs: DataFrame, asked: Broadcast, k: int) -> DataFrame:
    """(item_id, doc_id, score): the ``k`` best of each query in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, weight, n_docs, n_terms = asked.value
        best = [_Best(k) for _ in queries]
        waiting: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def search() -> None:
            ids, m, term, tf = zip(*waiting)
            shard = _Shard(np.array(ids, np.int64), np.array(m, np.int64), np.array([len(x) for x in term]), np.concatenate(term), np.concatenate(tf), weight)
            for (_, own), of in zip(queries, best):
                shard.search(own, of)

        postings = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, term, tf = _asked(text.as_py(), vocabulary)
                if len(term):
                    waiting.append((doc_id, 50 + 50 * n * n_docs // n_terms, term, tf))
                    postings += len(term)
                if postings >= SHARD_POSTINGS:
                    search()
                    waiting, postings = [], 0
        if waiting:
            search()
        for (item, _), of in zip(queries, best):
            if len(of.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of.doc), item)), pa.array(of.doc), pa.array(of.score)], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item_id", *by).orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents that score highest above 0 for each item.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased. N
    documents have a term, L terms in all; a term's weight is floor(1000 ln((2N + 2) / (2df + 1))), and a
    document with it tf times and n terms adds weight * (10^9 tf div (1000 tf + 20 m)), where m is
    50 + 50 n N div L. Ties go to the smaller doc_id.

    Each row of ``docs`` is a document, so repeated rows take places of their own. Rows with a null id or
    text take no part. Rows with one item_id are one query of all their terms, each once; items with a
    null id or no term have no row, as have empty tables. Texts of any length are read whole, a piece at
    a time. Items are a given set of queries: ``QUERY_BYTES`` of them are searched in one go.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).dropna()
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // QUERY_BYTES
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        wanted: dict[int, set[bytes]] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            wanted.setdefault(row.item_id, set()).update(t for piece in terms(bytes(row.text)) for t in piece)
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
        if not vocabulary:
            continue
        counts = {r.term: r.n for r in _statistics(docs, spark.sparkContext.broadcast(vocabulary)).toLocalIterator()}
        n_docs, n_terms = counts.get(_N) or 0, counts.get(_L) or 0
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        queries = [(item, np.array(sorted(vocabulary[t] for t in own), np.int64)) for item, own in wanted.items()]
        if n_terms:
            found = found.unionByName(_found(docs, spark.sparkContext.broadcast((vocabulary, queries, weight, n_docs, n_terms)), k))
    parted = _ranked(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), k, "part")
    return _ranked(parted.drop("rank", "part"), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
