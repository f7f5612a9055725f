"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A sequence of tokens is what the merges give for its bytes exactly if each neighbouring pair is what
they give for that pair's bytes. So reading left to right, one token ends at each place: the one that
is compatible with the token that ends where it begins. A place stays open while the bytes after it
begin a longer token. The machine's state is the last emitted token with the bytes behind it; once
all open places agree on a boundary, the tokens up to it are emitted. Lookahead is thus bounded by
the bytes that can still be part of one token, and states are built when first met.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm.common import map_batches

#: States and remembered pieces of one task; beyond that they are forgotten and built again.
MAX_STATES, MAX_PIECES, LONGEST_PIECE = 400_000, 350_000, 64
#: Ids that the decoder takes at once.
CHUNK = 8192


class _State:
    __slots__ = ("ends", "final", "next", "open", "pending")

    def __init__(self, pending: bytes, ends: list[int], open_at: list[int]):
        self.pending, self.ends = pending, ends  # ends[i]: token that ends after i bytes of pending
        self.open = open_at  # places from which the bytes on begin a longer token
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.final: tuple[int, ...] | None = None


class Transducer:
    """Encodes pieces of text by ``ranks`` (bytes to id, the lower merged first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.begins = {t[:n] for t in ranks for n in range(1, len(t))}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # pieces of the generation before
        self.states: dict[tuple[int, bytes], _State] = {}
        self.forget()

    def forget(self) -> None:
        for state in self.states.values():
            state.next.clear()  # states refer to one another: without this only a full collection frees them
        self.states = {}
        self.pairs.clear()
        self.start = self.states[-1, b""] = _State(b"", [-1], [])

    def _parts(self, data: bytes) -> list[list[bytes]]:
        """The sequences that the merges pass through."""
        parts = [data[i : i + 1] for i in range(len(data))]
        seen = [parts]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            seen.append(parts)
        return seen

    def _edge(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's left and right edge while it is merged: (bytes, rank of the merge
        that ends it). None if the merges don't give the token from its bytes."""
        if token not in self.edges:
            seen = self._parts(self.token[token])
            sides = []
            for side in (0, -1):
                at = list(dict.fromkeys(x[side] for x in seen))
                sides.append([(x, self.ranks[y]) for x, y in zip(at, at[1:])] + [(at[-1], 1 << 60)])
            self.edges[token] = tuple(sides) if len(seen[-1]) == 1 else None
        return self.edges[token]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the merges leave the two as they are (before < 0: the token alone): no merge across
        the boundary comes before the one that takes its left part, or before or with its right part's."""
        found = self.pairs.get(before << 32 | token)
        if found is None:
            right = self._edge(token)
            if right is None or before < 0:
                found = self.pairs[before << 32 | token] = right is not None
                return found
            left, right, rank = self._edge(before)[1], right[0], self.ranks.get
            i = j = 0
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                across = rank(x + y)
                if across is not None and across < x_end and across <= y_end:
                    found = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    found = True
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            self.pairs[before << 32 | token] = found
        return found

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        pending, ends, size = state.pending + bytes((byte,)), state.ends, self.size
        n, rank, begins, known = len(pending), self.ranks.get, self.begins, self.pairs.get
        chosen, still = None, []
        for begin in (*state.open, n - 1):
            tail = pending[begin:]
            if chosen is None:
                token = rank(tail)
                if token is not None:
                    fits = known(ends[begin] << 32 | token)
                    if self._fits(ends[begin], token) if fits is None else fits:
                        chosen = token
            if tail in begins:
                still.append(begin)
        if chosen is None:
            raise ValueError(f"no token for the byte {byte:#x}")
        ends = [*ends, chosen]
        cut = n
        for at in still:  # the last boundary that all open places come from
            while at != cut:
                if at > cut:
                    at -= size[ends[at]]
                else:
                    cut -= size[ends[cut]]
        key = (ends[cut], pending[cut:])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = _State(key[1], ends[cut:], [at - cut for at in still])
        state.next[byte] = found = (to, self._chain(ends, cut))
        return found

    def _chain(self, ends: list[int], at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(ends[at])
            at -= self.size[ends[at]]
        return tuple(reversed(out))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in data:
            state, emitted = state.next.get(byte) or self._step(state, byte)
            if emitted:
                out += emitted
        if state.final is None:
            state.final = self._chain(state.ends, len(state.pending))
        return (*out, *state.final)

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else self.encode_bytes(data)
            if len(self.states) > MAX_STATES:
                self.forget()
        if len(piece) <= LONGEST_PIECE:
            if len(self.pieces) >= MAX_PIECES:  # what is used again moves on, the rest goes with the next turn
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.pieces.get, out.extend
        for piece in self.split(text):
            ids = known(piece)
            if ids is None:
                ids = self._piece(piece)
                known = self.pieces.get
            extend(ids)
        return out


class Utf8Stream:
    """Incremental UTF-8: gives what is complete and keeps the bytes of an unfinished code point."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # begins a code point of 2, 3 or 4 bytes
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    cut = len(data) - back
                break
            if lead < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        left, self.pending = self.pending.decode("utf-8", "replace"), b""
        return left


def decode_stream(token: dict[int, bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text of the ids, as soon as its code points are complete."""
    stream = Utf8Stream()
    for chunk in batched(ids, CHUNK):
        yield stream.feed(b"".join(map(token.__getitem__, chunk)))
    yield stream.finish()


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or of the vocabulary in a ``.json`` file of tokenizers."""
    if path.endswith(".json"):
        letters = _byte_letters()
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(t): int(i) for t, i in map(bytes.split, filter(None, lines))}


@lru_cache(maxsize=2)
def transducer(path: str, pattern: str) -> Transducer:
    """One per Python worker. Its many long-lived objects make full collections rare but costly."""
    gc.set_threshold(50_000, 50, 1000)
    return Transducer(read_ranks(path), pattern)


def text_of(value: bytes | None) -> str:
    """A text as read from a binary column: null is empty, invalid bytes become U+FFFD."""
    return value.decode("utf-8", "replace") if value else ""


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of each row; null and empty texts have no ids, special tokens none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(path, pattern)
        ids = [machine.encode(text_of(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(narrow, run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token = transducer(path, pattern).token
        texts = ["".join(decode_stream(token, x or ())) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(ids.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the digests of its ids and of what they decode to.

    One pass without a shuffle; rows are independent, so repeated rows give repeated results.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(path, pattern)
        token, digits = machine.token, _digits(path, pattern)
        counts, of_ids, of_text = [], [], []
        for value in batch.column(1).to_pylist():
            ids = machine.encode(text_of(value))
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            decoded = hashlib.sha256()
            for part in decode_stream(token, ids):
                decoded.update(part.encode())
            of_text.append(decoded.hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(narrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@lru_cache(maxsize=2)
def _digits(path: str, pattern: str) -> dict[int, str]:
    return {i: str(i) for i in transducer(path, pattern).token}
