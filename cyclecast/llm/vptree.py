"""Approximate nearest neighbours in vantage-point trees, one per shard.

A node keeps a row, the median distance to the rows below it, and the nearer and the farther half. A
search goes to the half that the query is in and then to the other if the triangle inequality lets it
hold something within the k-th best distance divided by ``relax``; 1 is exact, more prunes earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm import vectors

LEAF = 256
#: Recall against brute force is measured in the README.
RELAX = 1.1


class VPTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.distances = x, ids, 0
        self.rng = np.random.default_rng(0)
        self.root = self._build(np.arange(len(x))) if len(x) else None

    def _build(self, rows: np.ndarray):
        """A leaf is its rows; a node (rows with the vantage point, median, nearer, farther)."""
        if len(rows) <= LEAF:
            return rows
        some = self.rng.choice(rows, 5, replace=False)  # the one with the widest spread of distances
        spread = [np.sqrt(((self.x[rows[:: max(1, len(rows) // 64)]] - self.x[s]) ** 2).sum(1)).std() for s in some]
        vantage = some[int(np.argmax(spread))]
        rest = rows[rows != vantage]
        far = np.sqrt(((self.x[rest] - self.x[vantage]) ** 2).sum(1))
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        return np.array([vantage]), float(far[order[half]]), self._build(rest[order[:half]]), self._build(rest[order[half:]])

    def search(self, q: np.ndarray, own: int, k: int, relax: float) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found, but the id ``own``."""
        found: list[tuple[float, int]] = []
        reach = np.inf
        stack = [(0.0, self.root)]
        while stack:
            least, node = stack.pop()
            if least > reach / relax + 1e-12:
                continue
            rows = node[0] if isinstance(node, tuple) else node
            self.distances += len(rows)
            far = np.sqrt(((self.x[rows] - q) ** 2).sum(1))
            fit = np.flatnonzero((far <= reach) & (self.ids[rows] != own))
            if len(fit) > k:  # those at least as near as the page's k-th
                fit = fit[far[fit] <= np.partition(far[fit], k - 1)[k - 1]]
            if len(fit):
                found = sorted([*found, *zip(far[fit].tolist(), self.ids[rows[fit]].tolist())])[:k]
                if len(found) == k:
                    reach = found[-1][0]
            if isinstance(node, tuple):
                _, median, nearer, farther = node
                d = float(far[0])
                sides = [(max(least, median - d), farther), (max(least, d - median), nearer)]
                stack += sides if d < median else sides[::-1]
        return found


def nearest(rows: DataFrame, every: int, k: int, relax: float = RELAX, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (id divisible by ``every``) the k nearest rows found: query_id, rank, vec_id, score.

    The score is the Euclidean distance in double precision. All rows but the query's own are indexed
    and candidates; ties go to the smaller id. Null and zero vectors, and those with null or
    non-finite components, take no part; shorter ones end in zeros; rows with one id are one vector.
    """
    if relax < 1:
        raise ValueError("relax must be at least 1")
    clean = vectors.clean(rows, id_col, vector_col).where(F.exists("v", lambda x: x != 0)).checkpoint()
    facts = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked")).first()
    shards = max(1, -(-facts.n // vectors.SHARD_ROWS))
    width = facts.width or 0

    def task(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if asked.num_rows and held.num_rows:
            tree = VPTree(vectors.matrix(held.column("v"), width), held.column("id").to_numpy())
            for q, own in zip(vectors.matrix(asked.column("v"), width), asked.column("id").to_pylist()):
                out += [(own, i, d) for d, i in tree.search(q, own, k, relax)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    data = clean.withColumn("shard", vectors.spread(F.col("id"), shards, 7))
    queries = clean.where(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    blocks = max(1, -(-(facts.asked or 0) // vectors.BLOCK_QUERIES))
    return vectors.best(vectors.search(data, queries, blocks, task, "query_id long, vec_id long, score double"), k, F.col("score"))
