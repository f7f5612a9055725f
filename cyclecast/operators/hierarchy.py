"""Region, management, sector and city as one table of nodes, from shares down to reconciled totals."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cyclecast.operators.features import before
from cyclecast.operators.folds import pooled_ets, pooled_ets_choice

LEVELS = ("region", "management", "sector", "city")
#: The columns that name a node at each level.
PATHS = {"region": ["region"], "management": ["region", "management"], "sector": ["region", "management", "sector"], "city": ["region", "management", "sector", "state", "city"]}


def node_id(level: str | None) -> Column:
    """The path's names as a JSON list; above the roots: empty."""
    return F.to_json(F.array(*PATHS[level])) if level else F.lit("")


def node_totals(panel: DataFrame) -> DataFrame:
    """Items and window geometry of each node and cycle, all levels.

    Sums add cities; geometry is over a node's distinct sectors, whose rows come from one aggregate
    of the panel, so every level reads that and not the panel.
    """
    sectors = panel.groupBy("region", "management", "sector", "cycle").agg(
        F.sum("items").alias("items"), F.min("opening_date").alias("opening_date"), F.max("closing_date").alias("closing_date"),
        F.min("window_start").alias("window_start"), F.first("cycle_days").alias("cycle_days"),
    )
    geometry = [
        F.sum("items").alias("items"), F.min("opening_date").alias("opening_date"), F.max("closing_date").alias("closing_date"), F.min("window_start").alias("window_start"),
        F.avg("cycle_days").alias("cycle_days"), F.min("cycle_days").alias("days_min"), F.max("cycle_days").alias("days_max"),
        F.avg(F.weekday("window_start")).alias("opening_weekday_mean"), F.avg(F.dayofmonth("window_start")).alias("opening_day_mean"),
    ]
    found = None
    for parent, level in zip((None, *LEVELS), LEVELS):
        rows = panel if level == "city" else sectors
        own = rows.groupBy(node_id(level).alias("node"), node_id(parent).alias("parent"), "cycle").agg(*geometry).withColumn("level", F.lit(level))
        found = own if found is None else found.unionByName(own)
    return found


def with_children(nodes: DataFrame) -> DataFrame:
    """Number of children, of active ones, and the largest child's share; 0 at the leaves."""
    children = nodes.where("parent <> ''").groupBy(F.col("parent").alias("node"), "cycle").agg(
        F.count("*").alias("n_children"), F.sum((F.col("items") > 0).cast("int")).alias("active_children"), F.max("items").alias("_largest")
    )
    joined = nodes.join(children, ["node", "cycle"], "left")
    share = F.when(F.col("level") == LEVELS[-1], 0.0).otherwise(F.col("_largest") / F.nullif(F.col("items").cast("double"), F.lit(0.0)))
    return joined.withColumn("largest_share", share).drop("_largest").fillna(0, ["n_children", "active_children"])


def with_parent(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("node").alias("parent"), "cycle", F.col("items").alias("parent_actual"))
    return nodes.join(parents, ["parent", "cycle"], "left")


def _spec() -> WindowSpec:
    return Window.partitionBy("node").orderBy("opening_date")


def node_features(nodes: DataFrame) -> DataFrame:
    """History, shares, structure and intermittency of the cycles before each row; any number of rows counts.

    ``nodes`` has parent_actual and children; one window serves all features.
    """
    w = _spec()
    last = lambda n: before(w, n)
    items = F.col("items").cast("double")
    mean = {n: F.avg(items).over(last(n)) for n in (3, 5, 10)}
    shares = [(F.sum(items).over(last(n)) / F.nullif(F.sum(F.col("parent_actual").cast("double")).over(last(n)), F.lit(0.0))).alias(f"share_{n}") for n in (1, 2, 3, 5, 10)]
    position = F.row_number().over(w) - 1
    bought = F.max(F.when(F.col("items") > 0, F.col("_at"))).over(before(w))
    rows = nodes.withColumn("_at", position)
    return rows.select(
        "node", "parent", "level", "cycle", "opening_date", "items",
        *(F.lag(items, n).over(w).alias(f"lag_{n}") for n in (1, 2, 3)), *(mean[n].alias(f"mean_{n}") for n in (3, 5, 10)),
        F.stddev_samp(items).over(last(5)).alias("std_5"), (mean[3] / F.nullif(mean[10], F.lit(0.0))).alias("trend_ratio"),
        F.avg(F.when(F.col("items") > 0, items)).over(last(5)).alias("positive_mean_5"), *shares,
        F.avg(F.col("parent_actual").cast("double")).over(last(5)).alias("parent_mean_5"), F.lag("largest_share").over(w).alias("previous_largest_share"),
        F.lag("n_children").over(w).alias("known_children"), (F.lag("n_children").over(w) - F.lag("n_children", 2).over(w)).alias("children_change"),
        F.avg("active_children").over(last(5)).alias("recent_active_children"), F.col("_at").alias("n_history"),
        F.avg((F.col("items") > 0).cast("double")).over(last(5)).alias("purchase_frequency_5"), (F.col("_at") - bought).alias("cycles_since_purchase"),
    )


def normalize_siblings(scores: DataFrame) -> DataFrame:
    """``(node, parent, level, share)`` from scores: shares among siblings, uniform where all are 0."""
    value = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    siblings = Window.partitionBy("parent")
    rows = scores.withColumn("_v", value).withColumn("_t", F.sum("_v").over(siblings)).withColumn("_n", F.count("*").over(siblings))
    share = F.when(F.col("_t") > 0, F.col("_v") / F.nullif("_t", F.lit(0.0))).otherwise(1.0 / F.col("_n"))
    return rows.select("node", "parent", "level", share.alias("share"))


def historical_shares(training: DataFrame, window: int = 5, prior: float = 5.0) -> DataFrame:
    """Each node's share of its parent: the recent ratio of sums drawn to the long one by n / (n + prior)."""
    back = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("opening_date")))
    rows = training.where("parent <> ''").withColumn("_b", back)
    recent = F.col("_b") <= window
    sums = rows.groupBy("node", "parent", "level").agg(
        F.sum(F.when(recent, F.col("items").cast("double"))).alias("a"), F.sum(F.when(recent, F.col("parent_actual").cast("double"))).alias("b"),
        F.sum(F.col("items").cast("double")).alias("c"), F.sum(F.col("parent_actual").cast("double")).alias("d"), F.sum(recent.cast("int")).alias("n"),
    )
    ratio, long, weight = F.col("a") / F.nullif("b", F.lit(0.0)), F.col("c") / F.nullif("d", F.lit(0.0)), F.col("n") / (F.col("n") + prior)
    return normalize_siblings(sums.select("node", "parent", "level", F.coalesce(ratio * weight + long * (1 - weight), long).alias("score")))


def distribute(roots: DataFrame, shares: DataFrame) -> DataFrame:
    """``(node, level, value)``: root values passed down by the shares, a join per level."""
    found = now = roots.select("node", F.lit(LEVELS[0]).alias("level"), "value")
    for level in LEVELS[1:]:
        own = shares.where(F.col("level") == level)
        now = own.join(now.select(F.col("node").alias("parent"), "value"), "parent").select("node", "level", (F.col("value") * F.col("share")).alias("value"))
        found = found.unionByName(now)
    return found


def incoherent(values: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Parents (node, value) whose children ``(node, parent, value)`` don't add up to them."""
    sums = values.where("parent <> ''").groupBy(F.col("parent").alias("node")).agg(F.sum("value").alias("children"))
    joined = values.join(sums, "node")
    return joined.where(F.abs(F.col("value") - F.col("children")) > tolerance).select("node", "value", "children")


def edges(nodes: DataFrame) -> DataFrame:
    """``(leaf, ancestor)``, each leaf its own one too: the summing matrix as a table."""
    parents = nodes.select("node", "parent").distinct()
    now = nodes.where(F.col("level") == LEVELS[-1]).select(F.col("node").alias("leaf"), F.col("node").alias("ancestor")).distinct()
    found = now
    for _ in LEVELS[1:]:
        now = now.join(parents, now["ancestor"] == parents["node"]).where("parent <> ''").select("leaf", F.col("parent").alias("ancestor"))
        found = found.unionByName(now)
    return found


def reconcile(base: DataFrame, iterations: int = 400) -> DataFrame:
    """``(fold, node, value)``: non-negative leaves whose sums are nearest to ``base`` at all levels.

    ``base(fold, node, parent, level, value, scale)``: least squares of (value - sum) / scale by
    accelerated projected gradients on the sparse edges, a task per fold. A fold is one origin's nodes,
    which a region's catalogue bounds.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        place = {n: i for i, n in enumerate(rows["node"])}
        parent = dict(zip(rows["node"], rows["parent"]))
        leaves = [n for n, level in zip(rows["node"], rows["level"]) if level == LEVELS[-1]]
        at, column = [], []
        for j, leaf in enumerate(leaves):
            node = leaf
            while node in place:
                at.append(place[node])
                column.append(j)
                node = parent[node]
        at, column = np.array(at, int), np.array(column, int)
        scale, target = rows["scale"].to_numpy(float), rows["value"].to_numpy(float)
        own = scale[[place[n] for n in leaves]]
        weight = own[column] / scale[at]  # leaves in units of their own scale

        def forward(x: np.ndarray) -> np.ndarray:
            return np.bincount(at, weight * x[column], len(rows))

        def back(r: np.ndarray) -> np.ndarray:
            return np.bincount(column, weight * r[at], len(leaves))

        v = np.ones(len(leaves))
        for _ in range(30):
            v = back(forward(v))
            norm = np.linalg.norm(v)
            v = v / (norm or 1.0)
        step = 1.0 / max(norm * 1.01, 1e-12)
        x = np.maximum(target[[place[n] for n in leaves]] / own, 0)
        y, t = x, 1.0
        for _ in range(iterations):
            new = np.maximum(y - step * back(forward(y) - target / scale), 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
        return pd.DataFrame({"fold": rows["fold"], "node": rows["node"], "value": np.bincount(at, own[column] * x[column], len(rows))})

    return base.groupBy("fold").applyInPandas(solve, "fold long, node string, value double")


# -- forecasts of all nodes, a cycle after another ---------------------------------------------------

#: Duration exponents and smoothing weights that the roots are tried with.
ROOT_ALPHAS, ROOT_EXPONENTS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.5, 1.0)


def latest_organization(history: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` with the region and management that each sector had last."""
    last = history.groupBy("sector").agg(F.max_by(F.struct("region", "management"), "opening_date").alias("_o"))
    return queries.join(last, "sector", "left").select(*queries.columns, "_o.region", "_o.management")


def root_forecast(nodes: DataFrame, query: DataFrame) -> DataFrame:
    """``(node, value)`` of ``query(node, cycle_days)``: smoothed levels per unit of window length.

    The weight and the exponent of the length are shared by all roots: those of the least one-step error.
    """
    rows = nodes.select(F.col("node").alias("serie"), "opening_date", "items", "cycle_days")
    folded = pooled_ets(rows, list(ROOT_ALPHAS), list(ROOT_EXPONENTS)).checkpoint()
    best = F.broadcast(pooled_ets_choice(folded).select("alpha", "exponent"))
    levels = folded.join(best, ["alpha", "exponent"]).select(F.col("serie").alias("node"), "level", "exponent")
    value = F.greatest(F.col("level") * F.pow(F.col("cycle_days").cast("double"), F.col("exponent")), F.lit(0.0))
    return query.select("node", "cycle_days").join(levels, "node", "left").select("node", F.coalesce(value, F.lit(0.0)).alias("value"))


def sector_shares(panel: DataFrame, window: int = 5) -> DataFrame:
    """``(serie, share)``: how a city's total under one management is split among its sectors.

    By items of the last ``window`` cycles, where these have none by all, and evenly where there are none.
    """
    recent = panel.select("cycle", "opening_date").groupBy("cycle").agg(F.min("opening_date").alias("_d")).orderBy(F.desc("_d"), F.desc("cycle")).limit(window)
    rows = panel.join(F.broadcast(recent.select("cycle", F.lit(True).alias("_recent"))), "cycle", "left")
    sums = rows.groupBy("serie", "region", "management", "state", "city").agg(F.sum(F.when(F.col("_recent"), F.col("items")).otherwise(0)).alias("a"), F.sum("items").alias("b"))
    group = Window.partitionBy("region", "management", "state", "city")
    score = F.when(F.sum("a").over(group) > 0, F.col("a")).otherwise(F.col("b")).cast("double")
    sums = sums.withColumn("s", score)
    total = F.sum("s").over(group)
    return sums.select("serie", F.when(total > 0, F.col("s") / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count("*").over(group)).alias("share"))


def forecast_cycle(panel: DataFrame, query: DataFrame, share_window: int = 5, prior: float = 5.0) -> DataFrame:
    """``(node, level, value)`` for ``query``, the panel rows of one cycle to come without items.

    Roots are smoothed, all below take their historical shares, so every parent is its children's sum.
    """
    nodes = with_parent(node_totals(panel)).checkpoint()
    asked = node_totals(query.withColumn("items", F.lit(0.0))).select("node", "parent", "level", "cycle_days").checkpoint()
    roots = root_forecast(nodes.where(F.col("level") == LEVELS[0]), asked.where(F.col("level") == LEVELS[0]))
    known = historical_shares(nodes, share_window, prior).select("node", F.col("share").alias("score"))
    shares = normalize_siblings(asked.where("parent <> ''").join(known, "node", "left").select("node", "parent", "level", F.coalesce("score", F.lit(0.0)).alias("score")))
    return distribute(roots, shares)


def forecast_path(panel: DataFrame, queries: DataFrame, share_window: int = 5, prior: float = 5.0) -> DataFrame:
    """``queries`` (panel rows of cycles to come, without items) with ``level_pred``, cycle after cycle.

    A cycle's forecasts become history for the next ones; what really came is never used. The cycles of a
    path are few, and a checkpoint ends each one's lineage.
    """
    columns = [c for c in panel.columns if c in queries.columns or c == "items"]
    cycles = [r.cycle for r in queries.groupBy("cycle").agg(F.min("opening_date").alias("d")).orderBy("d", "cycle").collect()]
    known, found = panel.select(columns), None
    for cycle in cycles:
        query = queries.where(F.col("cycle") == cycle)
        values = forecast_cycle(known, query, share_window, prior).where(F.col("level") == LEVELS[-1])
        told = query.withColumn("node", node_id("city")).join(values.select("node", F.col("value").alias("level_pred")), "node", "left").drop("node").checkpoint()
        known = known.unionByName(told.withColumn("items", F.coalesce("level_pred", F.lit(0.0))).select(columns))
        found = told if found is None else found.unionByName(told)
    return found


def score(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecasts ``(node, level, value)`` beside actual nodes ``(node, level, items)``; either may be missing.

    ``has_prediction`` tells which were forecast; ``active`` is false for cities without demand.
    """
    mine = predicted.select("node", F.col("level").alias("_l"), "value")
    both = mine.join(actual.select("node", "level", F.col("items").cast("double").alias("actual")), "node", "full_outer")
    level, observed = F.coalesce("level", "_l"), F.coalesce("actual", F.lit(0.0))
    return both.select("node", level.alias("level"), "value", observed.alias("actual"), F.col("value").isNotNull().alias("has_prediction"), ((level != LEVELS[-1]) | (observed > 0)).alias("active"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Errors by level for all points and for active ones, with the share of the demand that was forecast."""
    scopes = F.explode(F.when(F.col("active"), F.array(F.lit("all"), F.lit("active"))).otherwise(F.array(F.lit("all"))))
    error = F.abs(F.col("value") - F.col("actual"))
    told = F.when(F.col("has_prediction"), F.col("actual"))
    return scored.withColumn("scope", scopes).groupBy("scope", "level").agg(
        F.count("*").alias("n"), F.count_if("has_prediction").alias("n_predicted"), F.avg(error).alias("mae"), (F.sum(error) / F.nullif(F.sum(told), F.lit(0.0))).alias("wmape"),
        (F.sum(told) / F.nullif(F.sum("actual"), F.lit(0.0))).alias("coverage"),
    )
