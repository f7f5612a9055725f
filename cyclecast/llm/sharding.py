"""Shards in random order by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters whole rows uniformly into buckets that fit in memory, by a seeded hash. The
second lays each bucket out by ``shuffle``, Spark's Fisher-Yates permutation of an array, and deals the
buckets' rows out to the shards in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.llm.common import fresh

#: Bytes of a bucket on average, as ``row_bytes`` tells; it is an array in the memory of one task.
BUCKET_BYTES = 16 << 20
#: Copies of a row that one step spreads, buckets whose offsets one task adds up.
CHUNK = 4096
#: Rows of narrow tables (under 40 bytes each) that may be broadcast, so that texts don't move to meet them.
FEW = 500_000


def row_bytes(rows: DataFrame) -> Column:
    """About how many bytes a row takes: its strings and binaries, and 16 for each column."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in rows.dtypes if t in ("string", "binary")]
    return sum(texts, F.lit(16 * len(rows.columns))).cast("long")


def _spread(counted: DataFrame, copies: str, copy: str) -> DataFrame:
    """Each row ``copies`` times, numbered by ``copy``: first the chunks, dealt out, then what is in them."""
    chunk = fresh(counted, "_chunk")
    chunks = counted.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / CHUNK))))
    chunks = chunks.repartition(F.xxhash64(*counted.columns, chunk))
    last = F.least(F.lit(CHUNK), F.col(copies) - F.col(chunk) * CHUNK) - 1
    return chunks.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(copy, F.col(chunk) * CHUNK + F.col(copy)).drop(chunk)


def shuffle_shards(rows: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of ``rows`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    Law ``rows``: the shards' counts are at most one apart. A row's bucket is a hash of all that it has,
    so a task that runs again scatters alike; rows that fill a bucket by repetition are numbered and
    scatter by their numbers, too. Whole rows move once. A row of more bytes than a bucket is alone in the
    memory of its task with others of its bucket. The same input, seed and bucket size give the same
    order. An empty table gives no row. Columns may hold nulls but no maps; a name that ``rows`` has
    gets an underscore.
    """
    shard, slot = fresh(rows, "shard"), fresh(rows, "slot")
    names = ("copies", "copy", "h1", "h2", "bytes", "bucket", "row", "offset", "place", "part", "n")
    copies, copy, h1, h2, size, bucket, row, offset, place, part, n = (fresh(rows, f"_{x}") for x in names)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    keyed = rows.withColumns({h1: F.xxhash64(F.lit(seed), *columns), h2: F.xxhash64(*columns, F.lit(seed))})
    counted = keyed.select(h1, h2, row_bytes(rows).alias(size)).groupBy(h1, h2).agg(F.count("*").alias(copies), F.sum(size).alias(size)).checkpoint()
    buckets = max(1, -(-(counted.agg(F.sum(size)).first()[0] or 0) // bucket_bytes))
    crowd = (F.col(copies) > 1) & (F.col(size) > bucket_bytes // 8)
    at = lambda *key: F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    # narrow: where each bucket begins; ``part`` by ``part``, so no task sees all buckets of a large table
    single = counted.where(~crowd).select(at(h1, h2).alias(bucket), F.col(copies).alias(n))
    several = counted.where(crowd)
    few = F.broadcast if several.count() <= FEW else lambda df: df
    spread = _spread(several.select(h1, h2, copies), copies, copy).select(at(h1, h2, copy).alias(bucket), F.lit(1).cast("long").alias(n))
    sizes = single.unionByName(spread).groupBy(bucket).agg(F.sum(n).alias(n)).withColumn(part, F.floor(F.col(bucket) / CHUNK)).checkpoint()
    parts = sizes.groupBy(part).agg(F.sum(n).alias("_all"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(part, before(Window.orderBy(part), "_all").alias("_before"))  # a row per CHUNK buckets
    offsets = sizes.join(parts, part).select(bucket, (F.col("_before") + before(Window.partitionBy(part).orderBy(bucket), n)).alias(offset))

    whole = [*rows.columns, h1, h2]
    light = keyed.join(few(several.select(h1, h2)), [h1, h2], "left_anti").select(*whole, at(h1, h2).alias(bucket), F.lit(0).cast("long").alias(copy))
    heavy = keyed.join(few(several.select(h1, h2, copies)), [h1, h2]).groupBy(h1, h2).agg(F.first(F.struct(*columns)).alias(row), F.first(copies).alias(copies))
    heavy = _spread(heavy, copies, copy).select(*(F.col(row)[c].alias(c) for c in rows.columns), h1, h2, at(h1, h2, copy).alias(bucket), copy)
    scattered = light.unionByName(heavy).repartitionById(buckets, bucket)
    laid = scattered.groupBy(bucket).agg(F.sort_array(F.collect_list(F.struct(h1, h2, copy, F.struct(*columns).alias(row)))).alias(row))
    laid = laid.select(bucket, F.posexplode(F.shuffle(row, seed=F.lit(seed))).alias(place, row))
    laid = laid.join(F.broadcast(offsets) if buckets <= FEW else offsets, bucket)
    index = F.col(offset) + F.col(place)
    return laid.select(*(F.col(row)[row][c].alias(c) for c in rows.columns), (index % shards).cast("int").alias(shard), F.floor(index / shards).cast("long").alias(slot))


def write_shards(rows: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes each shard to ``path/shard=N``: a file per bucket, in which the slots rise."""
    laid = shuffle_shards(rows, shards, seed, bucket_bytes)
    shard, slot = laid.columns[-2:]
    laid.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), from the
    whole rows as they are laid out."""
    laid = shuffle_shards(docs, shards, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    return laid.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(laid.columns[-2]).alias("shard"), F.col(laid.columns[-1]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
