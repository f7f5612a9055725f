"""Lines that repeat across documents, exactly or within one edit, by a deletion-neighbourhood join.

Two lines within one edit share a variant: one line itself and the other with a character deleted,
or both with the same character's place deleted. All variants are emitted as hashed keys, equal ones
meet, the edit distance is verified and the earliest line stays.

Most lines have no partner. So first each line emits three keys, of which partners share one: its
first two thirds, its last two thirds, its outer thirds. Only lines with a key that another line has
emit variants, of deletions in the third left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.llm.common import bitmap, fresh, in_bitmap, join_counted, map_batches

#: Shorter lines (in code points, without outer white space) have to be equal to repeat another.
MIN_EDIT_CHARS = 10
#: Variants that go to Spark at once.
VARIANTS = 1 << 15
_PRIME = (1 << 31) - 1
_BASES = np.random.default_rng(42).integers(1 << 20, _PRIME, (4, 1))
_INVERSES = np.array([[pow(int(b), -1, _PRIME)] for b in _BASES.ravel()])
_LINE = "h1 long, h2 long, doc_id long, line int"


def lines_of(text: bytes | None) -> list[str]:
    return text.decode("utf-8", "replace").split("\n") if text is not None else []


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def part_keys(line: str) -> list[tuple[int, int, int]]:
    """(key, begin, end): begin and end bound the deletions for partners that share the key.

    Partners' lengths differ by one at most, so both are in a class of 2q - 1 to 2q + 1 characters. A
    third is a third of the shortest: an edit leaves one of the three parts of the line as it was.
    """
    size, found = len(line), []
    for q in {size // 2, (size + 1) // 2}:
        third = (2 * q - 1) // 3
        parts = ((line[: 2 * third], 2 * third, size), (line[-2 * third :], 0, size - 2 * third), (line[:third] + line[-third:], third, size - third))
        found += [(xxhash.xxh64_intdigest(part, 3 * q + kind) >> 1, begin, end) for kind, (part, begin, end) in enumerate(parts)]
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    """Each line that isn't blank: its hash and place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at, line in enumerate(lines_of(text)):
                line = line.strip()
                if line:
                    h1, h2 = _signed(xxhash.xxh3_128_digest(line.encode()))
                    for column, value in zip(out, (h1, h2, doc_id, at)):
                        column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["h1", "h2", "doc_id", "line"])

    return map_batches(docs, run, _LINE)


def _shared_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """The part keys that different lines share."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h1, keys, seen = [], [], set()
        for text in batch.column(1).to_pylist():
            for line in lines_of(text):
                line = line.strip()
                if len(line) >= min_chars and line not in seen:
                    seen.add(line)
                    own = _signed(xxhash.xxh3_128_digest(line.encode()))[0]
                    for key, _, _ in part_keys(line):
                        h1.append(own), keys.append(key)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(h1, pa.int64())], ["key", "h1"])

    keys = map_batches(docs, run, "key long, h1 long")
    return keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")


def _candidates(docs: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """Of each line with shared keys: its hash, text, earliest place and these ``keys`` (at most six).

    A bitmap keeps most other lines off the shuffle; the join leaves none of them.
    """
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap(shared))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        met = filter_.value
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at, line in enumerate(lines_of(text)):
                line = line.strip()
                if len(line) < min_chars:
                    continue
                keys = [k for k, _, _ in part_keys(line) if in_bitmap(met, k)]
                if keys:
                    h1, h2 = _signed(xxhash.xxh3_128_digest(line.encode()))
                    for column, value in zip(out, (h1, h2, doc_id, at, line, keys)):
                        column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["h1", "h2", "doc_id", "line", "text", "keys"])

    met = map_batches(docs, run, _LINE + ", text string, keys array<long>")
    met = met.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("place"), F.any_value("text").alias("text"), F.any_value("keys").alias("keys")).checkpoint()
    held = met.select("h1", "h2", F.explode("keys").alias("key")).join(shared, "key", "left_semi")
    held = held.groupBy("h1", "h2").agg(F.collect_set("key").alias("keys"))
    return met.drop("keys").join(held, ["h1", "h2"])


def _powers(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the bases, a row each."""
    out, step = np.ones((4, 1), np.int64), _BASES
    while out.shape[1] < n:
        out = np.concatenate([out, out * step % _PRIME], 1)
        step = step * step % _PRIME
    return out[:, :n]


def variant_keys(line: str, deleted: np.ndarray) -> np.ndarray:
    """Two numbers for the line, then for it without the character at each place of ``deleted``.

    Polynomial hashes, four residues of 31 bits: from sums over the characters before and behind a
    place, all variants of a line cost time and memory in proportion to its length.
    """
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.int64) + 1
    before = np.zeros((4, len(codes) + 1), np.int64)
    np.cumsum(codes * _powers(len(codes)) % _PRIME, axis=1, out=before[:, 1:])
    before %= _PRIME
    whole = before[:, -1:]
    rest = (before[:, deleted] + (whole - before[:, deleted + 1]) % _PRIME * _INVERSES) % _PRIME
    residues = np.concatenate([whole, rest], 1)
    return np.stack([residues[0] << 31 | residues[1], residues[2] << 31 | residues[3]], 1)


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(v1, v2, at) of each line itself (at -1) and of its deletions in the parts that its keys leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[int], keys: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
            v, take = np.concatenate(keys), pa.array(np.repeat(rows, [len(x) for x in at]))
            columns = [pa.array(np.ascontiguousarray(v[:, 0])), pa.array(np.ascontiguousarray(v[:, 1])), pa.array(np.concatenate(at).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, batch.column("h1").take(take), batch.column("place").take(take)], ["v1", "v2", "at", "h1", "place"])

        for batch in batches:
            rows, keys, at, n = [], [], [], 0
            for i, (text, shared) in enumerate(zip(batch.column("text"), batch.column("keys").to_pylist())):
                text = text.as_py()
                deleted = np.unique(np.concatenate([np.arange(b, e) for k, b, e in part_keys(text) if k in shared]))
                rows.append(i), keys.append(variant_keys(text, deleted)), at.append(np.concatenate([[-1], deleted]))
                n += len(at[-1])
                if n >= VARIANTS:
                    yield out(rows, keys, at)
                    rows, keys, at, n = [], [], [], 0
            if rows:
                yield out(rows, keys, at)

    return lines.select("h1", "place", "text", "keys").mapInArrow(run, "v1 long, v2 long, at int, h1 long, place struct<doc_id: long, line: int>")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def earliest(docs: DataFrame, occurrences: DataFrame, max_edits: int = 1, min_edit_chars: int = MIN_EDIT_CHARS) -> DataFrame:
    """``(h1, h2, first, n)`` of the lines that another line repeats: the place of the earliest one, and
    how often the line occurs.

    Lines that share a variant are never paired: in sorted runs of a variant, the line that is the
    variant takes the earliest of those that reach it by a deletion and they take its place, and of
    those with the same place deleted each takes the earliest.
    """
    counted = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    if not max_edits:
        return counted.where("n > 1")
    docs = _narrow(docs)
    lines = _candidates(docs, _shared_keys(docs, min_edit_chars).checkpoint(), min_edit_chars).checkpoint()
    run, same = Window.partitionBy("v1", "v2"), Window.partitionBy("v1", "v2", "at")
    found, whole = F.struct("place", "h1"), F.col("at") == -1
    met = _neighbourhood(lines).select(
        "h1", "place",
        F.when(whole, F.min(F.when(~whole, found)).over(run)).otherwise(
            F.least(F.min(F.when(whole, found)).over(run), F.min(found).over(same))
        ).alias("other"),
    )
    best = met.where("other.place < place").groupBy("h1", "place").agg(F.min("other").alias("other"))
    mine = lines.select("h1", "h2", "place", "text")
    other = lines.select(F.col("h1").alias("o1"), F.col("place").alias("first"), F.col("text").alias("other_text"))
    best = best.select("h1", "place", F.col("other.h1").alias("o1"), F.col("other.place").alias("first"))
    near = best.join(mine, ["h1", "place"]).join(other, ["o1", "first"]).where(F.levenshtein("text", "other_text", 1) >= 0)
    found = counted.withColumn("near", F.lit(False)).unionByName(near.select("h1", "h2", "first", F.lit(0).cast("long").alias("n"), F.lit(True).alias("near")))
    found = found.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("near").alias("near"))
    return found.where("n > 1 or near").drop("near")


def dropped_lines(docs: DataFrame, max_edits: int = 1, min_edit_chars: int = MIN_EDIT_CHARS) -> DataFrame:
    """``(doc_id, dropped)``: of each document that loses lines, their numbers (from 0) and first places.

    A line goes if a line before it, by doc_id and then by number, is equal or within ``max_edits``
    (0 or 1) insertions, deletions or substitutions of a code point, outer white space aside. Lines
    of under ``min_edit_chars`` code points have to be equal. Blank lines stay. Rows with one doc_id are
    one place: none is before the other. Null ids come first and lose no line. Null and empty texts
    have no line, an empty table gives no row. The places of a very common line stay where they are.
    """
    if max_edits not in (0, 1) or min_edit_chars < 3:
        raise ValueError("max_edits must be 0 or 1, min_edit_chars at least 3")
    occurrences = _occurrences(_narrow(docs)).checkpoint()
    firsts = earliest(docs, occurrences, max_edits, min_edit_chars).checkpoint()
    late = join_counted(occurrences, firsts, ["h1", "h2"], "n", occurrences.count()).where(F.struct("doc_id", "line") > F.col("first"))
    late = late.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.struct("line", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"))).alias("dropped"))
    return late.select("doc_id", F.sort_array("dropped").alias("dropped"))


def dedup(docs: DataFrame, max_edits: int = 1, min_edit_chars: int = MIN_EDIT_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of text, and ``dropped``, what ``dropped_lines`` tells.

    ``dropped`` (with underscores before it if ``docs`` has such a column) is null where no line went.
    Every row stays, with all its columns; rows with null ids or texts stay as they are. An empty table
    gives no row.
    """
    key, dropped = fresh(docs, "_id"), fresh(docs, "dropped")
    gone = dropped_lines(docs, max_edits, min_edit_chars).select(F.col("doc_id").alias(key), F.col("dropped").alias(dropped))
    split, left = fresh(docs, "_lines"), fresh(docs, "_left")
    rows = docs.join(gone, F.col("doc_id") == F.col(key), "left").drop(key)
    # array_except asks a set, so a text costs its lines, however many of them go
    rows = rows.withColumn(split, F.when(F.col(dropped).isNotNull(), F.split("text", "\n", -1)))
    rows = rows.withColumn(left, F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.transform(dropped, lambda x: x["line"])))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n")
    return rows.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(kept)).drop(split, left)


def keep_new_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with their repeated lines dropped and n_chars adjusted, without those left blank by it."""
    found = dedup(docs)
    name = found.columns[-1]
    found = found.where(F.col(name).isNull() | F.col("text").rlike("\\S"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else found.drop(name)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_dropped, the dropped lines with the documents that had them first,
    and the digest of the text that stays (null text: null)."""
    found = dedup(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.coalesce(F.transform("dropped", lambda x: x["line"]), F.array().cast("array<int>")).alias("dropped_lines"),
        F.coalesce(F.transform("dropped", lambda x: x["first_doc_id"]), F.array().cast("array<long>")).alias("first_doc_ids"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    ).select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines", "first_doc_ids", "kept_sha256")
