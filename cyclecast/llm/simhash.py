"""SimHash near-duplicates by multi-index hashing.

A fingerprint holds, for each bit, whether over half of a text's word shingles have it in their
hash. ``link_exactly`` cuts 64-bit fingerprints into two segments, enumerates the small Hamming
balls in them, fetches what the tables hold under those keys and verifies whole distances.
``link_wide`` finds candidates by wider fingerprints at a larger radius, inside sorted buckets;
``link_alike`` verifies them by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm.common import bitmap, components, in_bitmap, join_counted, map_batches

SEED = 42
#: Most fingerprints of a bucket that are compared in pairs; see ``link_exactly``.
CROWD = 64

#: For each byte value eight counters of one byte, the first for its highest bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; the whole sequence if it is shorter."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not parts:
        return np.empty(0, ">u8")
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        return np.frombuffer(digest(joined, SEED), ">u8")
    ends = list(accumulate(map(len, parts)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends)]
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]), ">u8")


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Independent bits from the same hashes (the SplitMix64 finaliser); lane 0 keeps them."""
    if not lane:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + _GOLDEN * np.uint64(lane)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).astype(">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255):  # a counter of one byte holds 255
        counts += _SPREAD[octets[at : at + 255]].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, f0, f1, ...)``: one signed 64-bit lane of the fingerprint in each f.

    Null, empty and blank texts have fingerprint zero. Every row has one; texts are read whole.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[] for _ in range(lanes)]
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, words)
            for lane in range(lanes):
                out[lane].append(majority(_mixed(hashes, lane)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names)

    names = ["doc_id", *(f"f{i}" for i in range(lanes))]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(narrow, run, ", ".join(f"{n} long" for n in names))


def _ball(segment, bits: int):
    """Keys within one bit, from the side that has the bit set: the pair meets at the smaller key."""
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(segment, i) == 1),
        lambda i: segment.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    return F.concat(F.array(segment), flips)


def link_exactly(unique: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``f0`` at ``radius`` (at most 2) or fewer bits.

    Two segments of 32 bits: of two bits, at most one falls into the first, or none into the second.
    So balls of radius 1 in the first and 0 in the second find each pair; ``bit_count`` verifies it.
    A bucket with over ``CROWD`` fingerprints isn't paired: whatever looks there goes, with its ball
    of radius 1 in all 64 bits, to groups by that exact key. Two fingerprints within 2 bits share a
    key there, those that share one are within 2 bits, and a key has 65 members at most, so a link
    to the smallest of each group connects all of them, with rows in proportion to the input.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    f = F.col("f0")
    segments = (F.shiftrightunsigned(f, 32), f.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    links, crowded = [], []
    for segment, ball in zip(segments, (1 if radius else 0, 0)):
        held = unique.select(segment.alias("key"), f.alias("b"))
        asked = unique.select(F.explode(_ball(segment, 32) if ball else F.array(segment)).alias("key"), f.alias("a"))
        full = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key")
        pairs = asked.join(held.join(full, "key", "left_anti"), "key")
        links.append(pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        crowded.append(asked.join(full, "key", "left_semi").select("a"))
    whole = F.concat(F.array("a"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = crowded[0].union(crowded[1]).distinct()
    if radius == 2:
        groups = near.select(F.explode(whole).alias("key"), "a").groupBy("key").agg(F.collect_set("a").alias("all"))
        star = groups.where(F.size("all") > 1).select(F.array_min("all").alias("b"), F.explode("all").alias("a"))
        links.append(star.where("a <> b").select("a", "b"))
    else:  # within one bit: the ball's own key meets the other's centre
        centre = near.select(F.col("a").alias("key"), F.col("a").alias("b"))
        ball = near.select(F.explode(whole).alias("key"), "a") if radius else near.select(F.col("a").alias("key"), "a")
        links.append(ball.join(centre, "key").where("a <> b").select("a", "b"))
    return links[0].union(links[1]).union(links[2])


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked).

    Exact within 64 bits. Equal fingerprints meet in one aggregation, so copies are never paired;
    only distinct fingerprints are linked. Repeated rows give repeated rows; an empty table gives no
    row; a null doc_id gets the component of its fingerprint and never names one unless all are null.
    """
    rows = fingerprints(docs, words, 1, id_col, text_col).checkpoint()
    unique = rows.groupBy("f0").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).checkpoint()
    nodes = components(link_exactly(unique, radius))
    linked = unique.join(nodes, F.col("f0") == F.col("node"))
    ids = linked.groupBy("component").agg(F.min("first").alias("linked_first"))
    linked = nodes.join(ids, "component").select(F.col("node").alias("f0"), "linked_first")
    named = unique.join(linked, "f0", "left").select("f0", "n", F.coalesce("linked_first", "first").alias("component_id"))
    found = join_counted(rows, named.checkpoint(), ["f0"], "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# -- wide fingerprints ------------------------------------------------------------------------------

#: The distance is that of the first two lanes: for texts whose five-word shingles have similarity 0.8,
#: 19 of 128 bits on average, deviation 4; ``WIDE_RADIUS`` allows for over three deviations, and what it
#: lets through is verified.
WIDE_RADIUS = 34
#: Share of the pairs at the least similarity that some segment brings together, by the binomial model.
RECALL = 0.993
#: Least bits of a segment, and rows that a bucket of unlike ones has on average at most.
LEAST_BITS, BUCKET_ROWS = 16, 64
#: Least Jaccard similarity of the sets of shingles: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Rows of a bucket that are compared at once; buckets of so many are compared together.
BLOCK, SMALL = 1024, 64
#: Candidates from which sketches come before whole sets, and bits of a sketch.
SKETCHED, SKETCH_BITS = 50_000, 2048
#: Ids that may be broadcast (some 10 MB), so that texts don't move to meet them.
FEW = 500_000
#: Bits of the smaller sketch that goes with the rarest shingles of a set, and residues by which they are counted.
TOKEN_BITS, COUNTED = 512, 1 << 20


def wide_plan(n: int) -> tuple[int, int]:
    """Bits of a segment and number of segments, each with a ball of radius 1, for ``n`` rows.

    Segments grow with the logarithm of ``n``, so that buckets don't grow, and so many are taken that
    ``RECALL`` holds at every size: keys a row grow as a small power of ``n``, comparisons as the keys.
    """
    bits = LEAST_BITS
    while n * (1 + bits / 2) > BUCKET_ROWS << bits:
        bits += 1
    least = NUMERATOR / DENOMINATOR
    differ = acos(2 * least / (1 + least)) / pi  # of a bit, for two sets of one size
    met = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return bits, ceil(log(1 - RECALL) / log(1 - met))


def _wide_keys(lanes: int, bits: int, segments: int, balls: bool = True):
    """Per row (node, lanes, others): a row (key, node, f0, f1, others) for each key of its segments' balls,
    or for the segments alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [np.asarray(c) for c in batch.columns]
        octets = np.stack(columns[1 : 1 + lanes], 1).astype(">i8").view(np.uint8).reshape(-1, 8 * lanes)
        cut = np.unpackbits(octets, axis=1)[:, : bits * segments].reshape(-1, segments, bits)
        powers = 1 << np.arange(bits)[::-1]
        own = cut @ powers
        row, segment, bit = np.nonzero(cut if balls else cut[:0])  # from the side that has the bit set: a pair meets at the smaller key
        at = np.concatenate([np.repeat(np.arange(len(own)), segments), row])
        key = np.concatenate([(own | np.arange(segments) << bits).ravel(), own[row, segment] ^ powers[bit] | segment << bits])
        carried = [0, 1, 2, *range(1 + lanes, len(columns))]
        names = ["key", *(batch.schema.names[c] for c in carried)]
        return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(columns[c][at]) for c in carried)], names)

    return run


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.int16) + np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of the pairs within the radius."""
    return np.nonzero(_distances(x, y) <= radius)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is connected to by the pairs."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _spanning(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Which pairs of places join the components ``comp`` (a place each), and the components then.

    Each component takes the pair with the earliest end at a time, so buckets that share rows often share
    links, and their distinct links are few.
    """
    taken, left = [], np.argsort(j, kind="stable")
    while True:
        left = left[comp[i[left]] != comp[j[left]]]
        if not len(left):
            return taken, comp
        at = left[np.unique(comp[i[left]], return_index=True)[1]]
        taken.append(at)
        comp = _labels(len(comp), comp[i[at]], comp[j[at]])[comp]


class _Bucket:
    """Links that connect the rows of one bucket, block by block.

    Rows lie in clusters: each is a leader or within the radius of one and linked to it. A row is compared
    with all leaders, and with the members of those clusters only that it isn't connected to and that the
    triangle inequality doesn't rule out. So a large group of near copies costs no more than its rows,
    and no pair of rows that are near stays unconnected.
    """

    def __init__(self, radius: int):
        self.radius, self.f, self.comp = radius, np.empty((0, 2), np.uint64), np.empty(0, np.int64)
        self.leaders, self.members, self.reach, self.label = np.empty(0, np.int64), [], [], None

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.comp[i] != self.comp[j]
        if apart.any():
            i, j = i[apart], j[apart]
            taken, self.comp = _spanning(self.comp, i, j)
            self.links += [np.stack([i[t], j[t]], 1) for t in taken]

    def add(self, x: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """The links (later row, earlier row) that at most ``BLOCK`` further rows bring.

        Rows come in the order of their labels, if they have any; those of one label are connected already.
        """
        self.links, base, radius = [], len(self.f), self.radius
        self.f = np.concatenate([self.f, x])
        own = np.arange(base, len(self.f))
        if label is not None:
            own = base + _run_starts(label)
            if base and label[0] == self.label:
                own[own == base] = self.comp[-1]
            self.label = label[-1]
        self.comp = np.concatenate([self.comp, own])
        far = _distances(x, self.f[self.leaders])
        cluster = np.where((far <= radius).any(1), far.argmin(1), -1) if len(self.leaders) else np.full(len(x), -1)
        i, j = np.nonzero(far <= radius)
        self._link(i + base, self.leaders[j])
        i, j = _near(x, x, radius)
        self._link(i[i > j] + base, j[i > j] + base)
        for c, (leader, reach) in enumerate(zip(self.leaders, self.reach)):
            rows = np.flatnonzero((far[:, c] <= radius + reach) & (self.comp[base:] != self.comp[leader])) if reach else ()
            for at in range(0, len(self.members[c]) if len(rows) else 0, BLOCK):
                some = self.members[c][at : at + BLOCK]
                i, j = _near(x[rows], self.f[some], radius)
                self._link(rows[i] + base, some[j])
        for c in np.unique(cluster[cluster >= 0]):
            rows = np.flatnonzero(cluster == c)
            self.members[c] = np.concatenate([self.members[c], rows + base])
            self.reach[c] = max(self.reach[c], int(far[rows, c].max()))
        left = np.flatnonzero(cluster < 0)
        while len(left):
            d = _distances(x[left[:1]], x[left])[0]
            self.leaders = np.append(self.leaders, left[0] + base)
            self.members.append(left[1:][d[1:] <= radius] + base)
            self.reach.append(int(d[d <= radius].max()))
            left = left[d > radius]
        return np.concatenate(self.links) if self.links else np.empty((0, 2), np.int64)


def _together(key: np.ndarray, f: np.ndarray, last: int | None, radius: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of a batch sorted by key: the near pairs (later, earlier) in buckets of at most ``SMALL`` rows that
    lie whole in it, and begins and ends of the other buckets.

    All small buckets are compared at once: each row with the row so many places before it.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    sizes = np.diff(cuts)
    whole = sizes <= SMALL
    whole[-1] = False  # may go on in the next batch
    whole[0] &= bool(key[0] != last)
    small, i, j = np.repeat(whole, sizes), [], []
    for back in range(1, int(sizes[whole].max(initial=1))):
        at = np.flatnonzero(small[back:] & (key[back:] == key[:-back])) + back
        near = np.bitwise_count(f[at] ^ f[at - back]).sum(1, dtype=np.int16) <= radius
        i.append(at[near])
        j.append(at[near] - back)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j]), [(int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(~whole)]


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns the place of the first equal one."""
    new = np.any([np.r_[True, c[1:] != c[:-1]] for c in columns], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _bucket_links(radius: int):
    """Per sorted bucket, also across batches: links that connect its rows, in proportion to its size.

    Rows may have labels, by which they are sorted within a bucket; rows of one label need no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, last = _Bucket(radius), np.empty(0, np.int64), None
        for batch in batches:
            key, node, f0, f1, *more = (np.asarray(c) for c in batch.columns)
            label = more[0] if more else node
            f = np.stack([f0, f1], 1).view(np.uint64)  # bitwise_count takes a signed number's absolute value
            i, j, others = _together(key, f, last, radius)
            taken, _ = _spanning(_run_starts(key, label), i, j)
            found = [np.stack([node[i[t]], node[j[t]]], 1) for t in taken]
            for begin, end in others:
                if key[begin] != last:
                    bucket, nodes = _Bucket(radius), node[:0]
                for at in range(begin, end, BLOCK):
                    to = min(at + BLOCK, end)
                    nodes = np.concatenate([nodes, node[at:to]])
                    found.append(nodes[bucket.add(f[at:to], label[at:to])])
                last = key[begin]
            last = key[-1]
            pairs = np.unique(np.concatenate(found), axis=0) if found else ()
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _allowed(m, n):
    """Most hashes that lie in one alone of two alike sets of ``m`` and ``n``."""
    return (DENOMINATOR - NUMERATOR) * (m + n) // (DENOMINATOR + NUMERATOR)


def _token_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shingle, sorted by label: the pairs of rows with different labels that size and sketch don't rule out.

    Rows are (key, label, node, size, sketch). Blocks of one label aren't compared, so a large group of true
    copies costs its rows.
    """
    own, last = None, None
    for batch in batches:
        key, label, node, size = (np.asarray(c) for c in batch.columns[:4])
        sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(key), -1)
        found = []
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        goes_on = np.r_[key[0] == last, np.zeros(len(cuts) - 2, bool)]
        ends = np.arange(len(cuts) - 1) == len(cuts) - 2  # may go on in the next batch
        for c in np.flatnonzero((np.diff(cuts) > 1) | goes_on | ends):
            rows = slice(cuts[c], cuts[c + 1])
            new = [label[rows], node[rows], size[rows], sketch[rows]]
            own = [np.concatenate(x) for x in zip(own, new)] if goes_on[c] else new
            for at in range(len(own[0]) - len(new[0]), len(own[0]), BLOCK):
                to = min(at + BLOCK, len(own[0]))
                for low in range(0, to, BLOCK):
                    high = min(low + BLOCK, to)
                    if own[0][low] != own[0][to - 1]:  # in order: else so are all between
                        i, j = _unlike_labels([x[at:to] for x in own], [x[low:high] for x in own])
                        found.append(np.stack([own[1][at + i], own[1][low + j]], 1))
        last = key[-1]
        pairs = np.concatenate(found) if found else ()
        if len(pairs):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["a", "b"])


def _unlike_labels(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y, both (label, node, size, sketch), of the pairs that may be alike under different labels."""
    m, n = x[2][:, None], y[2][None, :]
    open_ = (x[0][:, None] != y[0][None, :]) & (DENOMINATOR * np.minimum(m, n) >= NUMERATOR * np.maximum(m, n))
    i, j = np.nonzero(open_)
    apart = np.zeros(len(i), np.int64)
    for word in range(x[3].shape[1]):
        apart += np.bitwise_count(x[3][i, word] ^ y[3][j, word])
    near = apart <= _allowed(x[2][i], y[2][j])
    return i[near], j[near]


def _meet(rows: DataFrame, function, plan: tuple[int, int], *others: str, balls: bool = True) -> DataFrame:
    """``function`` on the sorted buckets of ``rows(node, f0, f1, ...)``: its pairs, the greater node first."""
    lanes = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    schema = ", ".join(f"{c} long" for c in ("key", "node", "f0", "f1", *others))
    keys = map_batches(rows.select("node", *lanes, *others), _wide_keys(len(lanes), *plan, balls), schema)
    pairs = keys.repartition("key").sortWithinPartitions("key", *others, "node").mapInArrow(function, "a long, b long")
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def link_wide(unique: DataFrame, plan: tuple[int, int], radius: int = WIDE_RADIUS) -> DataFrame:
    """Links ``(a, b)`` of ``unique(node, f0, f1, ...)`` that connect what meets in a segment and is near in f0, f1."""
    return _meet(unique, _bucket_links(radius), plan)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def wide_fingerprints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """``(doc_id, s0, s1, f0, f1, ...)``: 128 bits that tell the set of shingles, and its fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[] for _ in range(lanes + 2)]
        for text in batch.column(1).to_pylist():
            found = shingle_set(text, words)
            digest = xxhash.xxh3_128_digest(found.tobytes())
            out[0].append(int.from_bytes(digest[:8], "little", signed=True))
            out[1].append(int.from_bytes(digest[8:], "little", signed=True))
            found = found.astype(">u8")
            for lane in range(lanes):
                out[2 + lane].append(majority(_mixed(found, lane)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names)

    names = ["doc_id", "s0", "s1", *(f"f{i}" for i in range(lanes))]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(narrow, run, ", ".join(f"{n} long" for n in names))


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)


def _parities(found: np.ndarray, bits: int) -> bytes:
    """For each of so many residues whether an odd number of the hashes have it."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketch(found: np.ndarray) -> bytes:
    """The size of a set of shingles, and its parities for ``SKETCH_BITS`` residues."""
    return np.uint64(len(found)).tobytes() + _parities(found, SKETCH_BITS)


def _of_texts(docs: DataFrame, asked: DataFrame, words: int, name: str, function) -> DataFrame:
    """``(node, name)``: what ``function`` makes of the set of shingles of each text that ``asked(key)`` names.

    Texts stay where they are: a bitmap tells which of them are asked for (and lets a few more through).
    """
    def run(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([nodes, pa.array([function(x) for x in sets], pa.binary())], ["node", name])

    held = _map_sets(docs, docs.sparkSession.sparkContext.broadcast(bitmap(asked)), words, run, f"node long, {name} binary")
    return held.groupBy("node").agg(F.collect_set(name).alias(name))


def _map_sets(docs: DataFrame, filter_, words: int, function, schema: str) -> DataFrame:
    """``function`` on the doc_ids and sets of shingles of the texts that the broadcast bitmap lets through."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array([in_bitmap(filter_.value, n) for n in batch.column(0).to_pylist()], pa.bool_()))
        return function(batch.column(0), [shingle_set(t.as_py(), words) for t in batch.column(1)])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(texts, run, schema)


def sharing_rare(docs: DataFrame, rest: DataFrame, words: int) -> DataFrame:
    """The pairs ``(a, b)`` of ``rest(node, label)`` with different labels that may be alike: all that are, and few more.

    Of two alike sets each has at least the share N / D in the other. So in any one order of all shingles their
    first ones meet: of n the first n - ceil(n * N / D) + 1. The order is rarest first, by counts in ``COUNTED``
    residues, so that what a large group has in common comes last and its unlike texts seldom meet.
    """
    context = docs.sparkSession.sparkContext
    filter_ = context.broadcast(bitmap(rest.select(F.col("node").alias("key"))))

    def residues(_: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) % np.uint64(COUNTED), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n)], ["at", "n"])

    found = _map_sets(docs, filter_, words, residues, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTED, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    often = context.broadcast(counts)

    def first(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        rarest = []
        for x in sets:
            order = np.lexsort((x, often.value[(x % np.uint64(COUNTED)).astype(np.int64)]))
            rarest.append(x[order[: len(x) - -(-NUMERATOR * len(x) // DENOMINATOR) + 1]].view(np.int64))
        columns = [pa.array(rarest, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()), pa.array([_parities(x, TOKEN_BITS) for x in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([nodes, *columns], ["node", "keys", "size", "sketch"])

    sets = _map_sets(docs, filter_, words, first, "node long, keys array<long>, size long, sketch binary").join(rest, "node")
    rows = sets.select(F.explode("keys").alias("key"), "label", "node", "size", "sketch").repartition("key")
    pairs = rows.sortWithinPartitions("key", "label", "node").mapInArrow(_token_pairs, "a long, b long")
    return pairs.where("a <> b").distinct()


def _both(pairs: DataFrame, held: DataFrame, name: str, alike) -> DataFrame:
    """The ``pairs(a, b)`` of which some value of a and some of b are ``alike``."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([[np.frombuffer(v, np.uint64) for v in row] for row in batch.column(c).to_pylist()] for c in (2, 3))
        return batch.select(["a", "b"]).filter(pa.array([any(alike(p, q) for p in u for q in v) for u, v in zip(x, y)], pa.bool_()))

    both = pairs.join(held.select(F.col("node").alias("a"), F.col(name).alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col(name).alias("y")), "b")
    return map_batches(both.select("a", "b", "x", "y"), compare, "a long, b long")


def _maybe_alike(x: np.ndarray, y: np.ndarray) -> bool:
    """False only if the sets aren't alike: what both have cancels out, and each hash that one alone has changes one bit.

    So sketches differ in at most as many bits as hashes lie in one set alone, and of alike sets these are
    at most the share 1 - 2 * N / (N + D) of both sizes.
    """
    return int(np.bitwise_count(x[1:] ^ y[1:]).sum()) <= _allowed(int(x[0]), int(y[0]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()


def verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The ``pairs(a, b)`` of doc_ids whose texts' sets of shingles have the least similarity.

    Of more than ``SKETCHED`` pairs, sketches of 264 bytes rule out most that don't, so that few whole sets
    move. They rule out none that has it, so the result is the same without them; those left are counted exactly.
    """
    if pairs.count() > SKETCHED:
        pairs = _both(pairs, _of_texts(docs, _ends(pairs), words, "sketch", _sketch), "sketch", _maybe_alike).checkpoint()
    return _both(pairs, _of_texts(docs, _ends(pairs), words, "set", np.ndarray.tobytes), "set", _alike)


def _labelled(unique: DataFrame, links: DataFrame) -> DataFrame:
    """``unique`` with the component of its node as ``label``, the node itself if no link has it."""
    return unique.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _parted(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labels of the ends of the ``pairs`` that no link connects."""
    of = lambda end: labelled.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")).distinct()
    failed = pairs.join(of("a"), "a").join(of("b"), "b").where("a_label <> b_label")
    return failed.select(F.explode(F.array("a_label", "b_label")).alias("label")).distinct()


def link_alike(docs: DataFrame, unique: DataFrame, words: int, plan: tuple[int, int], radius: int = WIDE_RADIUS) -> DataFrame:
    """Verified links that connect all near pairs of ``unique`` whose shingles are alike.

    First rows meet in the segments without balls and each is linked to the earliest near one it meets
    there, so that a large group of near copies hangs together by a link a row. Rows with the label of an end
    of a candidate that fails are dense: near in their fingerprints and unlike. Then all meet in the balls,
    where only rows that neither a verified link nor being dense connects are linked. A near pair that meets
    is thus connected by links, by failed candidates and by dense rows; if links alone don't connect it, both
    ends have the label of a dense row or of a failed candidate's end. The rows of these labels are the rest,
    whose alike pairs ``sharing_rare`` finds without loss. So no failed candidate hides a true one, and unlike
    rows of a large group are never paired by their fingerprints.
    """
    first = _meet(unique, _bucket_links(radius), plan, balls=False).groupBy("a").agg(F.min("b").alias("b")).checkpoint()
    known = verified(docs, first, words).checkpoint()
    labelled = _labelled(unique, known).checkpoint()
    dense = labelled.join(_parted(first, labelled), "label", "left_semi").select("node", F.col("label").alias("dense")).distinct().checkpoint()
    one = dense.agg(F.min("dense")).first()[0]
    met = labelled.join(dense, "node", "left").withColumn("label", F.when(F.col("dense").isNull(), F.col("label")).otherwise(F.lit(one))).drop("dense")
    pairs = _meet(met, _bucket_links(radius), plan, "label").join(first, ["a", "b"], "left_anti").checkpoint()
    links = known.union(verified(docs, pairs, words)).checkpoint()
    tried = first.union(pairs)
    if tried.count() == links.count():
        return links
    labels = _labelled(unique.select("node").distinct(), links).checkpoint()
    parted = _parted(tried, labels).union(labels.join(dense, "node", "left_semi").select("label")).distinct()
    rest = labels.join(parted, "label", "left_semi").select("node", "label").checkpoint()
    more = sharing_rare(docs, rest, words).join(tried, ["a", "b"], "left_anti").checkpoint()
    return links.union(verified(docs, more, words)).checkpoint()


def keep_first(docs: DataFrame, words: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """The documents of ``docs`` without near-duplicates: of each group the smallest doc_id stays.

    Groups: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, and all that
    such links connect. Candidates come from wide fingerprints and each is verified; copies of one set
    meet without. Texts without a word (null, empty, blank) are no group and stay. Rows with one doc_id are
    one document: they stay or go together. Rows with a null doc_id stay. All columns of ``docs`` are
    kept. An empty table gives no row. Very long texts are read whole, each in one task.
    """
    blank = ~F.col("text").rlike("[^ \\t-\\r]")
    rows = docs.where(F.col("doc_id").isNotNull() & ~blank).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan = wide_plan(docs.count())
    lanes = [f"f{i}" for i in range(max(2, -(-plan[0] * plan[1] // 64)))]
    prints = wide_fingerprints(rows, words, len(lanes)).checkpoint()
    unique = prints.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), *(F.first(f).alias(f) for f in lanes)).checkpoint()
    same = prints.join(unique, ["s0", "s1"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = components(same.union(link_alike(rows, unique.select("node", *lanes), words, plan, radius)))
    gone = nodes.where("node <> component").select(F.col("node").alias("doc_id")).checkpoint()
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, "doc_id", "left_anti").select(docs.columns)
