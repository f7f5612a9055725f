"""Passages of words that documents share, by seed and extend.

Seeds: of each window of ``min_words`` words, the least hash among its shorter runs of words is its anchor
(winnowing). Equal windows have equal anchors at equal places, so documents that share a window meet when
they are joined on anchors; and each window belongs to one anchor only.

Extension, both ways from an anchor: first over all windows that belong to it at once. Where that whole
reach of words is equal, every document but the earliest repeats it. Of different reaches around one
anchor, the earliest document of each goes on window by window, and equal windows meet. Documents are
never paired: those that meet are told the earliest of them. Overlapping windows make the maximal repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm.common import bitmap, fresh, join_counted, map_batches

#: Bytes of a text that are split into words at once, words of short texts that are searched together and
#: windows searched at once, and rows of a batch that goes back to Spark.
PIECE, STEP, OUT_ROWS = 4 << 20, 1 << 16, 1 << 15
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: For each number of bytes up to 8 the bits of the first so many of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def normal(text: bytes) -> bytes:
    """The words joined by one space."""
    if len(text) <= PIECE:
        return b" ".join(text.split())  # of bytes: at exactly these six
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(normal(text[at:end]))
        at = end
    return b" ".join(filter(None, parts))


class Texts:
    """Texts one after another: their words joined, where each word begins, whose it is, and how many words
    are before each text."""

    def __init__(self, texts: list[bytes]):
        parts = [normal(t) for t in texts]
        counts = np.array([p.count(b" ") + 1 if p else 0 for p in parts], np.int64)
        self.joined = b" ".join(filter(None, parts))
        self.begins = np.zeros(counts.sum() + 1, np.int64)  # the last: where a further word would
        np.add(np.flatnonzero(np.frombuffer(self.joined + b" " * bool(self.joined), np.uint8) == 32), 1, out=self.begins[1:])
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        self.before = np.cumsum(counts) - counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    x = (x ^ x >> np.uint64(29)) * _MIX
    return x ^ x >> np.uint64(32)


def word_hashes(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, of its length and its first and last eight bytes. Others may share it: that
    brings no wrong result, as whole windows are compared by digests of all their bytes."""
    low, high = int(begin[0]), int(end[-1])
    octets = bytes(8) + joined[low:high] + bytes(8)
    any_eight = np.ndarray(len(octets) - 7, "<u8", octets, strides=(1,))
    size = end - begin
    head = any_eight[begin - low + 8] & _FIRST[np.minimum(size, 8)]
    tail = any_eight[end - low] & ~_FIRST[np.maximum(8 - size, 0)]  # the bytes of words before are left out
    return _mixed(_mixed(head ^ size.astype(np.uint64)) + tail)


@cache
def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(2 * STEP, base, np.uint64)], dtype=np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each ``k`` consecutive of up to two STEP words, from sums of powers modulo 2^64."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_BASE)[: len(h)], out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * _powers(pow(_BASE, -1, 1 << 64))[: len(h) - k + 1])


def _least(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` consecutive keys."""
    size = 1
    while 2 * size <= wide:
        keys, size = np.minimum(keys[:-size], keys[size:]), 2 * size
    return np.minimum(keys[: len(keys) - wide + size], keys[wide - size :]) if size < wide else keys


def _runs(keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, place)``: windows of ``wide`` keys that have their first least key at one place."""
    views = np.lib.stride_tricks.sliding_window_view(keys, wide)
    least = _least(keys, wide)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = views[first].argmin(1) + first
    last = np.append(first[1:], len(least)) - 1
    if (last > place).any():  # the least key is there more than once
        place = views.argmin(1) + np.arange(len(least))
        first = np.flatnonzero(np.diff(place, prepend=-1))
        place, last = place[first], np.append(first[1:], len(least)) - 1
    return first, last, place


def anchors(texts: Texts, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, first, last)``: each anchor's key, and the first and last window that it belongs to.

    Windows are numbered by their first words, through all texts; those that go on in another text are
    left out. Many words are searched step by step. An anchor's windows may be parted there, which only
    means that they are compared one by one.
    """
    k, n = max(1, min_words // 2), len(texts.owner)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, n - min_words + 1, STEP):
        own = texts.begins[at : at + STEP + min_words]
        owner = texts.owner[at : at + STEP + min_words - 1]
        keys = rolling(word_hashes(texts.joined, own[:-1], own[1:] - 1), k)
        first, last, place = _runs(keys, min_words - k + 1)
        whole = owner[min_words - 1 :] == owner[: len(owner) - min_words + 1]
        upto = np.zeros(len(whole) + 1, np.int64)
        np.cumsum(whole, out=upto[1:])
        left = upto[last + 1] - upto[first]  # of a run, windows side by side: it is shorter than what is left out
        some = left > 0
        first = np.flatnonzero(whole)[upto[first[some]]]
        found.append((keys[place[some]].view(np.int64), first + at, first + left[some] - 1 + at))
    key, first, last = (np.concatenate(x) for x in zip(*found))
    return key, first, last


def _digests(texts: Texts, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits, two numbers, of the words from each ``first`` to before each ``end``."""
    octets = memoryview(texts.joined)
    found = b"".join([xxhash.xxh3_128_digest(octets[a:b]) for a, b in zip(texts.begins[first].tolist(), (texts.begins[end] - 1).tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def _met(filter_: tuple[bytes, int], keys: np.ndarray) -> np.ndarray:
    octets, mask = np.frombuffer(filter_[0], np.uint8), filter_[1]
    return octets[(keys & mask) >> 3] >> (keys & 7).astype(np.uint8) & 1 == 1


def _emit(docs: DataFrame, found, schema: str) -> DataFrame:
    """The rows of ``found(texts, doc_id of each word, text's checksum for each word)``, an array a column."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]

    def rows(waiting: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        ids, texts = zip(*waiting)
        columns = found(Texts(texts), np.array(ids, np.int64), np.array([zlib.crc32(t) for t in texts], np.int64))
        for at in range(0, len(columns[0]), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT_ROWS], t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                waiting.append((doc_id, text.as_py()))
                size += len(waiting[-1][1])
                if size > 4 * STEP:
                    yield from rows(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from rows(waiting)

    return docs.mapInArrow(run, schema)


def _seeds(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id): the anchors of each document."""

    def found(texts: Texts, ids: np.ndarray, crcs: np.ndarray) -> list[np.ndarray]:
        key, first, _ = anchors(texts, min_words)
        return [key, ids[texts.owner[first]]]

    return _emit(docs, found, "key long, doc_id long")


def _places(texts: Texts, ids: np.ndarray, crcs: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """doc_id, crc, begin and end in words of the document."""
    owner = texts.owner[first]
    return [ids[owner], crcs[owner], first - texts.before[owner], end - texts.before[owner]]


def _occurrences(docs: DataFrame, shared: Broadcast, min_words: int) -> DataFrame:
    """Places of the ``shared`` anchors: the digest of the words that their windows reach, and these windows."""

    def found(texts: Texts, ids: np.ndarray, crcs: np.ndarray) -> list[np.ndarray]:
        key, first, last = anchors(texts, min_words)
        at = _met(shared.value, key)
        key, first, end = key[at], first[at], last[at] + min_words
        digest = _digests(texts, first, end)
        return [key, digest[:, 0], digest[:, 1], *_places(texts, ids, crcs, first, end)]

    return _emit(docs, found, "key long, s1 long, s2 long, doc_id long, crc long, begin int, end int")


def _windows(docs: DataFrame, shared: Broadcast, asked: Broadcast, min_words: int) -> DataFrame:
    """Each window of the reaches that are ``asked``, by its digest."""

    def found(texts: Texts, ids: np.ndarray, crcs: np.ndarray) -> list[np.ndarray]:
        key, first, last = anchors(texts, min_words)
        at = _met(shared.value, key)
        first, last = first[at], last[at]
        at = _met(asked.value, _digests(texts, first, last + min_words)[:, 0] ^ ids[texts.owner[first]])
        sizes = (last - first)[at] + 1
        begin = np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        digest = _digests(texts, begin, begin + min_words)
        return [digest[:, 0], digest[:, 1], *_places(texts, ids, crcs, begin, begin + min_words)]

    return _emit(docs, found, "w1 long, w2 long, doc_id long, crc long, begin int, end int")


def _later(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Those of ``rows`` that have the ``keys`` of a row with a smaller doc_id."""
    first = rows.groupBy(keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last").checkpoint()
    return join_counted(rows, first, keys, "n", total).where("doc_id > first").select("doc_id", "crc", "begin", "end")


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``(doc_id, crc, repeats)`` of the documents that repeat something: in order, the begins and ends (in
    words) of the maximal passages all of whose ``min_words``-word windows also start in a document with a
    smaller doc_id. crc, the CRC-32 of the text, tells different texts of one doc_id apart.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Rows with one doc_id are one document: none of them is
    before another. Rows with a null id or text, and texts of fewer words, repeat nothing; an empty table
    gives no row. Texts of any length are read whole, each in one task.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).dropna()
    shared = _seeds(docs, min_words).groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    anchored = context.broadcast(bitmap(shared))
    rows = _occurrences(docs, anchored, min_words).checkpoint()
    total = rows.count()
    whole = _later(rows, ["s1", "s2"], total)

    reach = rows.groupBy("s1", "s2").agg(F.first("key").alias("key"), F.min("doc_id").alias("first"))
    several = reach.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("first").alias("b")).where("n > 1 and a < b").select("key", "n").checkpoint()
    asked = join_counted(reach, several, ["key"], "n", total).select(F.col("s1").bitwiseXOR(F.col("first")).alias("key"))
    single = _windows(docs, anchored, context.broadcast(bitmap(asked)), min_words).checkpoint()
    found = whole.unionByName(_later(single, ["w1", "w2"], single.count()))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans in batch.column(2).to_pylist():
            own: list[dict] = []
            for x in sorted(spans, key=lambda x: x["begin"]):
                if own and x["begin"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], x["end"])
                else:
                    own.append(x)
            out.append(own)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.schema.field(2).type)], batch.schema.names)

    spans = found.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("begin", "end")).alias("repeats"))
    return map_batches(spans, merged, "doc_id long, crc long, repeats array<struct<begin: int, end: int>>")


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with repeats (see there; null where there is none), n_words, n_removed, and kept: the words
    that no repeat covers, joined by one space. Names that ``docs`` has get an underscore. Every row stays;
    rows with a null id keep all words, null texts have none and null as kept.
    """
    key, crc = fresh(docs, "_id"), fresh(docs, "_crc")
    new = [fresh(docs, x) for x in ("repeats", "n_words", "n_removed", "kept")]
    found = repeats(docs, min_words).toDF(key, crc, new[0])
    rows = docs.join(found, (F.col("doc_id").cast("long") == F.col(key)) & (F.crc32(F.col("text").cast("binary")) == F.col(crc)), "left").drop(key, crc)
    at = rows.columns.index("text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist()):
            words = (text.as_py() or "").encode().split()
            stays = np.ones(len(words), bool)
            for x in spans or ():
                stays[x["begin"] : x["end"]] = False
            n_words.append(len(words))
            n_removed.append(len(words) - int(stays.sum()))
            kept.append(b" ".join(compress(words, stays.tolist())) if text.is_valid else None)
        columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new[1:]])

    schema = rows.select("*", *(F.lit(None).cast("long" if c != new[3] else "string").alias(c) for c in new[1:])).schema
    return map_batches(rows, cut, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, the repeats' number and the digest of the words that stay."""
    found = dedup(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.coalesce(F.size("repeats"), F.lit(0)).cast("long").alias("n_repeats"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
