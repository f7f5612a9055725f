"""Packing of tokenised documents into sequences of a fixed length.

An order-preserving dynamic programme chooses where the stream of documents is cut. A window from
cut i to cut j costs its padding and the penalty of cutting at j, so with token places p

    cost[j] = penalty[j] + window - p[j] + min(cost[i] + p[i])    over p[j] - window <= p[i] < p[j]

and the minimum of a sliding window comes from a monotone queue, in time linear in the cuts.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm.bpe import read_ranks, text_of
from cyclecast.llm.common import kept, release

WINDOW = 1024
END = 0
#: In tokens of padding: what a cut costs at a document's end, at a sentence's end, elsewhere.
PENALTIES = (0, 2, 8)
#: Elsewhere, a document may be cut at each of its places that this divides.
STRIDE = 16
#: Tokens that are planned together; the last window of a block goes on in the next one.
BLOCK = 1 << 17

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indexes of the chosen ``places``, from 0 to the last one, at least cost.

    ``places`` rise from 0, no step longer than the window; of equal costs the earliest start wins.
    """
    at, extra = places.tolist(), penalties.tolist()
    best = [0.0] * len(at)
    came = [0] * len(at)
    queue = deque([(0.0, 0)])  # (cost + place, index), rising in both
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0][1]] > window:
            queue.popleft()
        low, i = queue[0]
        came[j] = i
        value = low + window + extra[j]  # cost[j] + p[j]
        best[j] = value - here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a file of tokenizers takes out of a text before it splits the rest.

    Those that also take white space around them, or stand only between words, aren't supported.
    """
    found = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or []
    for token in found:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"{path}: added token {token['content']!r} needs more than its own place")
    return {token["content"]: token["id"] for token in found}


@kept
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a worker, and whether each id ends a sentence."""
    ranks, added = read_ranks(path), added_tokens(path)
    ends = np.zeros(max([*ranks.values(), *added.values()]) + 1, bool)
    for token, i in ranks.items():
        ends[i] = token[-1:] in (b".", b"!", b"?", b"\n")
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), ends


class _Packer:
    """Plans blocks of one task's documents and gives their pieces."""

    def __init__(self, ends: np.ndarray, window: int, first_sequence: int):
        self.ends, self.window, self.sequence = ends, window, first_sequence
        self.docs: list[tuple] = []  # (doc_id, tokens before, ids, all tokens)
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)
        if self.tokens >= BLOCK:
            yield from self.plan(last=False)

    def plan(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        block = np.concatenate([ids for _, _, ids, _ in self.docs])
        kind = np.zeros(len(block) + 1, np.uint8)  # of the cut before each token: 1 + the penalty's index
        begin = 0
        for _, before, ids, _ in self.docs:
            kind[begin + (-before % STRIDE) : begin + len(ids) : STRIDE] = 3
            begin += len(ids)
        kind[1:][self.ends[block]] = 2
        begin = 0
        for _, _, ids, _ in self.docs:
            kind[begin] = 1
            begin += len(ids)
        kind[-1] = 1
        places = np.flatnonzero(kind)
        cuts = places[choose_cuts(places, np.array((0, *PENALTIES))[kind[places]], self.window)].tolist()
        if not last:
            cuts.pop()
        doc, begin = 0, 0
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                doc_id, before, ids, total = self.docs[doc]
                to = min(b, begin + len(ids))
                yield doc_id, before + at - begin, to - at, zlib.crc32(block[at:to]), total, self.sequence, at - a
                at = to
                if to == begin + len(ids):
                    doc, begin = doc + 1, to
            self.sequence += 1
        rest = self.docs[doc:]
        if rest and cuts[-1] > begin:
            doc_id, before, ids, total = rest[0]
            rest[0] = (doc_id, before + cuts[-1] - begin, ids[cuts[-1] - begin :], total)
        self.docs, self.tokens = ([], 0) if last else (rest, len(block) - cuts[-1])


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text by the vocabulary in ``path`` (null: none), then ``END``. Added
    tokens whose strings the text holds get their own ids, as tokenizers' encode does. Within
    each partition of ``docs`` the documents keep the order of doc_id (nulls first, then by text), so
    no text is shuffled and a task that runs again packs alike. Each id lies in one piece, pieces in
    one sequence, and only the last sequence of a task may be far from full. Rows are packed as often
    as they are repeated. An empty table gives no row. ``window`` is at least ``STRIDE``.
    """
    if window < STRIDE:
        raise ValueError(f"window must be at least {STRIDE}")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = _encoder(path, pattern)
        packer = _Packer(ends, window, TaskContext.get().partitionId() << 36)

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pieces)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.encode(text_of(text), allowed_special="all"), END], "<u4")
                if pieces := list(packer.add(doc_id, ids)):
                    yield out(pieces)
        if pieces := list(packer.plan(last=True)):
            yield out(pieces)
        release()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
