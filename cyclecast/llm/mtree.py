"""Exact top-k by inner product in M-trees.

Inner products become distances: with a coordinate sqrt(M - |x|^2) added to each row, M the largest
squared norm, and 0 to the query, the squared distance is |q|^2 + M - 2 q.x. Rows are dealt to the
nearest of a bounded number of pivots and each shard is a tree of paged nodes that store covering
radii and distances to the parent's pivot. A search takes nodes by their least possible distance and
computes a distance only where the stored ones don't rule it out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm import vectors

#: Entries of a page; pivots that rows are dealt to, at most.
LEAF, FANOUT, PIVOTS = 384, 12, 256


class _Node:
    __slots__ = ("children", "from_parent", "pivot", "radii", "rows")

    def __init__(self, pivot: np.ndarray):
        self.pivot = pivot
        self.rows: np.ndarray | None = None  # of a leaf
        self.children: list[_Node] = []
        self.from_parent = self.radii = np.empty(0)  # of the rows or children: distance to pivot, radius


class MTree:
    """Over rows of integers ``x`` with ``ids``; ``top`` is M, at least their largest squared norm."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, top: float):
        self.x, self.ids, self.top = x, ids, top
        self.flat = np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)
        self.distances = 0  # computed by searches
        self.rng = np.random.default_rng(0)
        self.root = self._build(np.arange(len(x)), self.flat[0]) if len(x) else None

    def _far(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.flat[rows] - pivot) ** 2).sum(1))

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> _Node:
        node = _Node(pivot)
        if len(rows) <= LEAF:
            node.rows, node.from_parent = rows, self._far(rows, pivot)
            return node
        centres = self.flat[self.rng.choice(rows, FANOUT, replace=False)]
        square = (self.flat[rows] ** 2).sum(1)[:, None] + (centres**2).sum(1) - 2 * self.flat[rows] @ centres.T
        owner = square.argmin(1)
        groups = [rows[owner == c] for c in range(FANOUT)]
        if max(map(len, groups)) == len(rows):  # all alike: pages of equal size
            groups = np.array_split(rows, FANOUT)
        for centre, group in zip(centres, groups):
            if len(group):
                node.children.append(self._build(group, centre))
                node.radii = np.append(node.radii, self._far(group, centre).max())
        node.from_parent = np.sqrt(((np.array([c.pivot for c in node.children]) - pivot) ** 2).sum(1))
        return node

    def search(self, q: np.ndarray, own: int, k: int, reach: float = np.inf) -> list[tuple[int, int]]:
        """(-score, id) of the k highest inner products with ``q``, but the id ``own``'s, within ``reach``."""
        flat, base = np.append(q, 0.0), float(q @ q) + self.top
        slack = 1e-9 * (1 + np.sqrt(base))
        found: list[tuple[int, int]] = []
        far = float(np.sqrt(((self.root.pivot - flat) ** 2).sum()))
        heap, order = [(0.0, 0, self.root, far)], 0
        while heap:
            least, _, node, far = heapq.heappop(heap)
            if least > reach + slack:
                break
            if node.rows is not None:
                rows = node.rows[np.abs(far - node.from_parent) <= reach + slack]
                self.distances += len(rows)
                scores = (self.x[rows] @ q).astype(np.int64)
                fit = np.flatnonzero(self.ids[rows] != own)
                if len(fit) > k:  # those at least as high as the page's k-th
                    fit = fit[scores[fit] >= np.partition(scores[fit], len(fit) - k)[len(fit) - k]]
                found = sorted([*found, *zip((-scores[fit]).tolist(), self.ids[rows[fit]].tolist())])[:k]
                if len(found) == k:
                    reach = min(reach, float(np.sqrt(max(base + 2 * found[-1][0], 0))))
                continue
            near = np.flatnonzero(np.abs(far - node.from_parent) - node.radii <= reach + slack)
            self.distances += len(near)
            if not len(near):
                continue
            to = np.sqrt(((np.array([node.children[i].pivot for i in near]) - flat) ** 2).sum(1))
            for i, d in zip(near, to):
                if (bound := max(d - node.radii[i], 0.0)) <= reach + slack:
                    order += 1
                    heapq.heappush(heap, (float(bound), order, node.children[i], float(d)))
        return found


def top_k(rows: DataFrame, every: int, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (id divisible by ``every``) its k highest integer inner products: query_id, rank, vec_id, score.

    Components are floor(scale * x). All rows but the query's own are candidates, ties go to the
    smaller id, and fewer candidates give fewer rows. Null vectors, and those with null or non-finite
    components, take no part; shorter ones end in zeros; rows with one id are one vector.
    """
    spark = rows.sparkSession
    clean = vectors.clean(rows, id_col, vector_col).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")).checkpoint()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("top"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked")).first()
    schema = "query_id long, vec_id long, score long"
    if not facts.n or not facts.width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, top = facts.width, facts.top
    count = min(PIVOTS, -(-facts.n // vectors.SHARD_ROWS))
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(max(count, 64)).toArrow()
    drawn = vectors.matrix(sample.column("v"), width)

    def lift(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)

    pivots = lift(drawn[:count])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = lift(vectors.matrix(batch.column("v"), width))
            far = np.sqrt(np.maximum((flat**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * flat @ pivots.T, 0))
            nearest = far.argmin(1)
            yield batch.append_column("pivot", pa.array(nearest.astype(np.int32))).append_column("far", pa.array(far[np.arange(len(far)), nearest]))

    dealt = clean.mapInArrow(deal, "id long, v array<double>, pivot int, far double")
    sizes = {r.pivot: (r.n, r.radius) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    parts, first, total = [0] * count, [0] * count, 0
    for p in range(count):
        first[p], parts[p] = total, -(-sizes.get(p, (0, 0.0))[0] // vectors.SHARD_ROWS)
        total += parts[p]
    radii = np.array([sizes.get(p, (0, 0.0))[1] for p in range(count)])
    at = F.col("pivot") + 1
    data = dealt.select("id", "v", (F.element_at(F.lit(first), at) + F.pmod(F.xxhash64(F.lit(5), "id"), F.element_at(F.lit(parts), at))).cast("int").alias("shard"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard whose rows may be within the k-th best of the sample."""
        for batch in batches:
            ids, q = batch.column("id").to_numpy(), vectors.matrix(batch.column("v"), width)
            flat = np.concatenate([q, np.zeros((len(q), 1))], 1)
            scores = q @ drawn.T
            scores[ids[:, None] == sample.column("id").to_numpy()[None, :]] = -np.inf
            kth = -np.sort(-scores, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            reach = np.sqrt(np.maximum((q * q).sum(1) + top - 2 * kth, 0))
            far = np.sqrt(np.maximum((flat**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * flat @ pivots.T, 0))
            near = far - radii <= reach[:, None] * (1 + 1e-9) + 1e-3
            row, pivot = np.nonzero(near)
            times = np.array(parts)[pivot]
            row, pivot = np.repeat(row, times), np.repeat(pivot, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = batch.take(pa.array(row))
            yield out.append_column("shard", pa.array((np.array(first)[pivot] + part).astype(np.int32))).append_column("reach", pa.array(reach[row] * (1 + 1e-9) + 1e-3))

    queries = clean.where(F.col("id") % every == 0).mapInArrow(ask, "id long, v array<double>, shard int, reach double")

    def task(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if asked.num_rows and held.num_rows:
            tree = MTree(vectors.matrix(held.column("v"), width), held.column("id").to_numpy(), top)
            qs = vectors.matrix(asked.column("v"), width)
            for q, own, reach in zip(qs, asked.column("id").to_pylist(), asked.column("reach").to_pylist()):
                out += [(own, i, -s) for s, i in tree.search(q, own, k, reach)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    blocks = max(1, -(-facts.asked // vectors.BLOCK_QUERIES))
    return vectors.best(vectors.search(data, queries, blocks, task, schema), k, -F.col("score"))
