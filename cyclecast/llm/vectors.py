"""What vector searches share: clean rows, and blocks of queries against shards of the data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard and of a block of queries, on average: what one task holds in memory.
SHARD_ROWS, BLOCK_QUERIES = 4096, 4096


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v array<double>)`` without null ids, null vectors, and null or non-finite components.

    Rows with one id are one vector; if they differ, the first in the order of arrays.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    found = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~odd)
    return found.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), np.float64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, int)])] = values
    return out


def spread(key: Column, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)).cast("int")


def search(data: DataFrame, queries: DataFrame, blocks: int, task: Callable, schema: str) -> DataFrame:
    """Applies ``task(data rows, queries)`` to each shard and block of queries that ask it.

    ``data(shard, id, v, ...)``; ``queries(shard, id, v, ...)``, a row per query and shard. A shard's
    rows go to as many tasks as there are blocks, so neither side of a task grows with the tables.
    """
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else data.withColumn("block", F.lit(0))
    queries = queries.withColumn("block", spread(F.col("id"), blocks, 3))
    return queries.groupBy("shard", "block").cogroup(data.groupBy("shard", "block")).applyInArrow(task, schema)


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The k first of each query by ``score`` (ascending), ties to the smaller id, with their rank.

    Each shard and block gives k rows of a query at most, so a query's list has k per shard.
    """
    rows = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(score.alias("s"), "vec_id", "score"))).alias("all"))
    ranked = rows.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
