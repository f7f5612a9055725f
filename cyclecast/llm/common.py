"""What several operators share: settings, durable checkpoints, components, task-local helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclecast.session import checkpoints

#: Rows in a batch that goes to Python; texts may be very long, so also few bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the batches sent to Python and makes sure that checkpoint() has a folder (see ``session``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    checkpoints(spark)
    return spark


def release() -> None:
    """Gives memory that is free in this Python worker back to the machine; the next task may be another stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


#: What ``kept`` holds in this Python worker.
_KEPT: list = []


def kept(function: Callable) -> Callable:
    """``function`` with its last result kept in the worker for later tasks.

    Workers outlive a query's stages, so to make a result drops what other functions have kept: a tokenizer
    doesn't stand beside the language models of a stage before.
    """
    cache = lru_cache(maxsize=1)(function)
    _KEPT.append(cache)

    @wraps(function)
    def call(*args):
        others = [c for c in _KEPT if c is not cache and c.cache_info().currsize]
        for other in others:
            other.cache_clear()
        if others:
            release()
        return cache(*args)

    call.cache_info = cache.cache_info
    return call


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``function`` to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)
        release()

    return df.mapInArrow(run, schema)


#: Least and greatest size of a bitmap, in powers of two.
BITMAP_LEAST, BITMAP_MOST = 16, 26


def bitmap(keys: DataFrame) -> tuple[bytes, int]:
    """A filter of ``keys(key)``, to be asked by ``in_bitmap``: a bit per value modulo the size.

    It has 16 bits a key, as far as ``BITMAP_MOST`` (8 MB) allows; beyond that it lets more through, so
    whoever asks it joins with the keys afterwards. The words are put together in Spark.
    """
    keys = keys.checkpoint()
    bits = 1 << min(max((16 * keys.count()).bit_length(), BITMAP_LEAST), BITMAP_MOST)
    at = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = keys.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(bits // 64, "<i8")
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return found.tobytes(), bits - 1


def in_bitmap(filter_: tuple[bytes, int], key: int) -> bool:
    octets, mask = filter_
    return octets[(key & mask) >> 3] >> (key & 7) & 1 == 1


#: A key with over this part of the rows is hot, so there are at most so many hot keys.
HOT_KEYS = 1024


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed`` on ``keys``, of which ``keyed`` has each once, ``n`` of them in ``rows``.

    Keys with over ``total / HOT_KEYS`` rows are at most ``HOT_KEYS``: they alone are broadcast, so their
    rows stay where they are. All others are shuffled, and none of them is more than that part.
    """
    hot = F.broadcast(keyed.where(F.col(n) > total // HOT_KEYS))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(n) <= total // HOT_KEYS), keys)
    return rows.join(hot, keys).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The connected components of ``edges(a, b)``: ``(node, component)``, the smallest node of each.

    Alternates large-star and small-star steps on the edges alone; only ids move, each step is two
    aggregations and two joins, and a checkpoint in the shared folder ends its lineage. Nodes without
    an edge have no row. Hubs are joined by sort-merge, which Spark splits when they are skewed.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = small.where("a <> b").distinct().checkpoint()
        # a fixed point: each node has one edge, and its end has none
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
