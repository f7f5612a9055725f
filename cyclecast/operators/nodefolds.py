"""Rolling back-tests of the whole hierarchy: all origins, nodes and candidates in one plan.

A row of ``nodes`` (see ``hierarchy.node_totals`` with its children and parents) is the target of its own
cycle. What it may learn from are the cycles that had closed before that cycle opened, which are a prefix
of the calendar. So each node keeps a running state, inclusive of its row, and a target takes the state
of the last row that had closed: one window over (node, cycle), whatever the number of origins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators.hierarchy import LEVELS, ROOT_ALPHAS, ROOT_EXPONENTS

#: Closed cycles that an origin needs; rows of recent shares and means; weight of the long history.
MIN_CLOSED, RECENT, PRIOR = 20, 5, 5.0


def closed_index(nodes: DataFrame) -> DataFrame:
    """``(cycle, idx, closed)``: cycles numbered by their openings, and how many of the first of them had all
    closed before each one opened. A cycle that closed out of turn waits for those before it."""
    cycles = nodes.groupBy("cycle").agg(F.min("opening_date").alias("opening_date"), F.max("closing_date").alias("closing_date"))
    cycles = cycles.withColumn("idx", F.row_number().over(Window.orderBy("opening_date", "cycle")))  # a row a cycle
    late = cycles.select(F.col("idx").alias("i"), F.coalesce("closing_date", F.lit("9999-12-31").cast("date")).alias("c"))
    found = cycles.crossJoin(F.broadcast(late)).where("c >= opening_date").groupBy("cycle", "idx").agg(F.min("i").alias("first_open"))
    return found.select("cycle", "idx", (F.col("first_open") - 1).alias("closed"))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _state() -> dict[str, Column]:
    """What a node knows after a row, that row included."""
    w = Window.partitionBy("node").orderBy("idx")
    last = lambda n: w.rowsBetween(1 - n, 0)
    every = w.rowsBetween(Window.unboundedPreceding, 0)
    items, parent = F.col("items").cast("double"), F.col("parent_actual").cast("double")
    bought, position = F.col("items") > 0, F.row_number().over(w)
    state = {f"lag_{n + 1}": F.lag(items, n).over(w) if n else items for n in range(3)}
    state |= {f"mean_{n}": F.avg(items).over(last(n)) for n in (3, RECENT, 10)}
    state |= {f"share_{n}": _ratio(F.sum(items).over(last(n)), F.sum(parent).over(last(n))) for n in (1, 2, 3, RECENT, 10)}
    return state | {
        "share_all": _ratio(F.sum(items).over(every), F.sum(parent).over(every)), "std_5": F.stddev_samp(items).over(last(5)), "trend_ratio": _ratio(state["mean_3"], state["mean_10"]),
        "positive_mean_5": F.avg(F.when(bought, items)).over(last(5)), "parent_mean_5": F.avg(parent).over(last(5)), "previous_largest_share": F.col("largest_share"),
        "known_children": F.col("n_children"), "children_change": F.col("n_children") - F.lag("n_children").over(w), "recent_active_children": F.avg("active_children").over(last(5)),
        "n_recent": F.count("*").over(last(RECENT)), "n_history": position, "n_bought": F.count(F.when(bought, 1)).over(every), "purchase_frequency_5": F.avg(bought.cast("double")).over(last(5)),
        "cycles_since_purchase": position - F.max(F.when(bought, F.col("_at"))).over(every) + 1, "last_start": F.col("window_start"),
    }


def with_closed_state(nodes: DataFrame) -> DataFrame:
    """``nodes`` with idx, closed and ``state``, what was known of each when its cycle opened; null where nothing was."""
    rows = nodes.join(F.broadcast(closed_index(nodes)), "cycle")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("node").orderBy("idx")))
    rows = rows.withColumn("_own", F.struct(*(value.alias(name) for name, value in _state().items())))
    # a row tells its state at its own place and asks at the place of what had closed
    both = rows.withColumn("_p", F.explode(F.array(F.struct(F.col("idx").alias("at"), F.lit(0).alias("asks")), F.struct(F.col("closed").alias("at"), F.lit(1).alias("asks")))))
    seen = F.last(F.when(F.col("_p.asks") == 0, F.col("_own")), True).over(Window.partitionBy("node").orderBy("_p.at", "_p.asks", "idx").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("state", seen).where("_p.asks = 1").drop("_own", "_p", "_at")


def targets(known: DataFrame, min_closed: int = MIN_CLOSED, last: int | None = None) -> DataFrame:
    """The rows of ``with_closed_state`` whose cycle is an origin: all with enough before them, or the last."""
    found = known.where(F.col("closed") >= min_closed)
    if last:
        kept = known.where(F.col("closed") >= min_closed).select("idx").distinct().orderBy(F.desc("idx")).limit(last)
        found = found.join(F.broadcast(kept), "idx", "left_semi")
    return found


def normalized(scores: DataFrame) -> DataFrame:
    """``share`` from ``score``: among the siblings of a cycle, even where all are 0."""
    siblings = Window.partitionBy("cycle", "parent")
    rows = scores.withColumn("_v", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_t", F.sum("_v").over(siblings)).withColumn("_n", F.count("*").over(siblings))
    return rows.withColumn("share", F.when(F.col("_t") > 0, F.col("_v") / F.nullif("_t", F.lit(0.0))).otherwise(1.0 / F.col("_n"))).drop("_v", "_t", "_n", "score")


def historical_score(prior: float = PRIOR) -> Column:
    """The recent ratio of sums drawn to the long one by n / (n + prior)."""
    weight = F.col("state.n_recent") / (F.col("state.n_recent") + prior)
    recent, long = F.col(f"state.share_{RECENT}"), F.col("state.share_all")
    return F.coalesce(recent * weight + long * (1 - weight), long, F.lit(0.0))


def root_levels(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``(cycle, node, value)`` of the roots ``asked``: smoothed per unit of window length, times the window's own.

    Per origin the weight and the exponent of the length have the least one-step error over all roots and
    closed cycles. A root and setting is folded once, and tells its level and error after each cycle.
    """
    rows = known.where(F.col("level") == LEVELS[0])
    arrays = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("items").cast("double").alias("x"), F.col("cycle_days").cast("double").alias("d")))).alias("s"))
    settings = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(e).alias("exponent")) for a in ROOT_ALPHAS for e in ROOT_EXPONENTS))
    each = arrays.select("node", "s", F.explode(settings).alias("g")).select("node", "s", "g.alpha", "g.exponent")
    out = F.struct(F.lit(0).alias("idx"), F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("error"))

    def step(told: Column, v: Column) -> Column:
        now, scale = F.element_at(told, -1), F.pow(v["d"], F.col("exponent"))
        x, first = v["x"] / scale, now["level"].isNull()
        level = F.when(first, x).otherwise(now["level"] + F.col("alpha") * (x - now["level"]))
        error = F.when(first, now["error"]).otherwise(now["error"] + F.abs(x - now["level"]) * scale)
        return F.concat(told, F.array(F.struct(v["idx"].alias("idx"), level.alias("level"), error.alias("error"))))

    told = each.select("node", "alpha", "exponent", F.explode(F.aggregate("s", F.array(out), step)).alias("t")).select("node", "alpha", "exponent", F.col("t.idx").alias("i"), "t.level", "t.error")
    roots = asked.where(F.col("level") == LEVELS[0]).select("cycle", "node", "cycle_days", F.col("closed").alias("_closed"))
    origins = roots.select("cycle", "_closed").distinct()
    upto = told.join(F.broadcast(origins), F.col("i") <= F.col("_closed"))
    now = upto.groupBy("cycle", "node", "alpha", "exponent").agg(F.max_by(F.struct("level", "error"), "i").alias("t"))
    sums = now.groupBy("cycle", "alpha", "exponent").agg(F.sum("t.error").alias("error"))
    best = sums.groupBy("cycle").agg(F.min_by(F.struct("alpha", "exponent"), F.struct(F.round("error", 6), "alpha", "exponent")).alias("b")).select("cycle", "b.alpha", "b.exponent")
    chosen = now.join(F.broadcast(best), ["cycle", "alpha", "exponent"])
    value = F.col("t.level") * F.pow(F.col("cycle_days").cast("double"), F.col("exponent"))
    return roots.join(chosen, ["cycle", "node"]).select("cycle", "node", F.greatest(value, F.lit(0.0)).alias("value"))


def distributed(roots: DataFrame, shares: DataFrame) -> DataFrame:
    """``(cycle, node, value)``: each cycle's root values passed down, a join per level."""
    now = roots.select("cycle", "node", "value")
    found = [now]
    for level in LEVELS[1:]:
        own = shares.where(F.col("level") == level).select("cycle", "node", "parent", "share")
        now = own.join(now.select("cycle", F.col("node").alias("parent"), "value"), ["cycle", "parent"]).select("cycle", "node", (F.col("value") * F.col("share")).alias("value"))
        found.append(now)
    return reduce(DataFrame.unionByName, found)


def forecasts(known: DataFrame, min_closed: int = MIN_CLOSED, last: int | None = None) -> DataFrame:
    """``(candidate, cycle, node, value)`` of all origins: each node's own recent mean, and recent and
    smoothed root totals passed down by historical shares among the nodes known at the time."""
    asked = targets(known, min_closed, last).where("state is not null")
    direct = asked.select("cycle", "node", "level", F.col(f"state.mean_{RECENT}").alias("value"))
    shares = normalized(asked.where("parent <> ''").select("cycle", "node", "parent", "level", historical_score().alias("score")))
    roots = direct.where(F.col("level") == LEVELS[0])
    tell = lambda name, rows: rows.select(F.lit(name).alias("candidate"), "cycle", "node", "value")
    found = [tell(f"direct_ma_{RECENT}", direct), tell(f"topdown_ma_{RECENT}", distributed(roots, shares)), tell("topdown_ets", distributed(root_levels(known, asked), shares))]
    return reduce(DataFrame.unionByName, found)


def scored(known: DataFrame, predicted: DataFrame, min_closed: int = MIN_CLOSED, last: int | None = None) -> DataFrame:
    """Every candidate on every target: nodes that nothing was known of count as forecast at 0, and are told."""
    actual = targets(known, min_closed, last).select("cycle", "node", "level", F.col("items").cast("double").alias("actual"))
    names = predicted.select("candidate").distinct()  # a few
    rows = actual.crossJoin(F.broadcast(names)).join(predicted, ["candidate", "cycle", "node"], "left")
    return rows.select("candidate", "cycle", "node", "level", "actual", F.coalesce("value", F.lit(0.0)).alias("predicted"), F.col("value").isNotNull().alias("has_prediction"), ((F.col("level") != LEVELS[-1]) | (F.col("actual") > 0)).alias("active"))


def summary(points: DataFrame, *by: str) -> DataFrame:
    """Errors by candidate, level (and ``by``) in both scopes: all points, and without cities that bought nothing.

    mae weighs nodes, mae_pooled points.
    """
    keys = ["scope", "candidate", "level", *by]
    scopes = F.explode(F.when(F.col("active"), F.array(F.lit("all"), F.lit("active"))).otherwise(F.array(F.lit("all"))))
    miss, has = F.col("predicted") - F.col("actual"), F.col("has_prediction")
    nodes = points.withColumn("scope", scopes).groupBy(*keys, "node").agg(
        F.avg(F.abs(miss)).alias("own"), F.sum(F.abs(miss)).alias("abs"), F.sum(miss).alias("miss"), F.sum("actual").alias("actual"), F.count("*").alias("n"),
        F.count_if(has).alias("told"), F.sum(F.when(has, F.col("actual")).otherwise(0.0)).alias("told_actual"),
    )
    percent = lambda x, whole: 100 * _ratio(x, whole)
    return nodes.groupBy(*keys).agg(
        F.avg("own").alias("mae"), (F.sum("abs") / F.sum("n")).alias("mae_pooled"), percent(F.sum("abs"), F.sum("actual")).alias("wmape_pct"), (F.sum("miss") / F.sum("n")).alias("bias"),
        percent(F.sum("miss"), F.sum("actual")).alias("bias_pct"), F.sum("n").alias("n_points"), F.count("*").alias("n_nodes"), (F.sum("n") - F.sum("told")).alias("n_missing"),
        (100 * F.sum("told") / F.sum("n")).alias("coverage_points_pct"), percent(F.sum("told_actual"), F.sum("actual")).alias("coverage_volume_pct"),
    )


# -- learned shares ---------------------------------------------------------------------------------

#: What the learner sees of a node: its closed history, its structure, the calendar, and what it and its
#: parent had on average in the training rows (codes of names would have to be as many as the nodes).
FEATURES = ["lag_1", "lag_2", "lag_3", "mean_3", "mean_5", "mean_10", "std_5", "trend_ratio", "positive_mean_5", "share_1", "share_2", "share_3", "share_5", "share_10", "parent_mean_5", "previous_largest_share", "known_children", "children_change", "recent_active_children", "n_history", "purchase_frequency_5", "cycles_since_purchase"]
CALENDAR = ["cycle_month", "cycle_number", "days_since_previous_opening", "cycle_days", "opening_weekday_mean", "opening_day_mean"]


def feature_rows(known: DataFrame) -> DataFrame:
    """Features as doubles; a missing one is -1, which none of them can be but a change of children."""
    own = [F.col(f"state.{c}").cast("double").alias(c) for c in FEATURES]
    when = [F.month("opening_date").alias("cycle_month"), F.right("cycle", F.lit(2)).cast("int").alias("cycle_number"), F.datediff("window_start", "state.last_start").alias("days_since_previous_opening"), "cycle_days", "opening_weekday_mean", "opening_day_mean"]
    rows = known.where("state is not null").select("cycle", "idx", "closed", "node", "parent", "level", "items", "parent_actual", "state", *own, *when)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in FEATURES + CALENDAR})


def learned(training: DataFrame, query: DataFrame, kind: str = "share", trees: int = 20, depth: int = 4, prior: float = PRIOR) -> DataFrame:
    """``(cycle, node, parent, level, score)`` of ``query``, one boosted model for all nodes of one level.

    ``kind``: ``share`` of the parent, or ``volume``. Both are rows of ``feature_rows``; only training
    rows, their averages by node and parent included, are learnt from. A city's score is drawn to its
    fallback (its historical share, or its recent mean) by n / (n + prior), n being the cycles in which it
    has bought; so is every score where nothing can be learnt.
    """
    label = F.col("items").cast("double") / (F.nullif(F.col("parent_actual").cast("double"), F.lit(0.0)) if kind == "share" else F.lit(1.0))
    fallback = historical_score(prior) if kind == "share" else F.coalesce(F.col(f"state.mean_{RECENT}"), F.lit(0.0))
    usable = training.withColumn("label", label).where("label is not null" + (" and parent_actual > 0" if kind == "share" else ""))
    sums = usable.agg(F.sum("label").alias("s"), F.avg("label").alias("m")).first()
    asked = query.select("cycle", "node", "parent", "level", *FEATURES, *CALENDAR, fallback.alias("fallback"), F.col("state.n_bought").alias("n"))
    if not sums.s:
        return asked.select("cycle", "node", "parent", "level", F.col("fallback").alias("score"))
    means = {key: usable.groupBy(key).agg(F.avg("label").alias(f"{key}_mean")) for key in ("node", "parent")}

    def table(rows: DataFrame) -> DataFrame:
        for key, of in means.items():
            rows = rows.join(of, key, "left")
        rows = rows.withColumn("parent_mean", F.coalesce("parent_mean", F.lit(sums.m))).withColumn("node_mean", F.coalesce("node_mean", "parent_mean"))
        return VectorAssembler(inputCols=[*FEATURES, *CALENDAR, "node_mean", "parent_mean"], outputCol="features").transform(rows)

    model = GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.1, maxBins=32, seed=42).fit(table(usable))
    told = model.transform(table(asked)).withColumn("_v", F.greatest("prediction", F.lit(0.0)))
    weight = F.when(F.col("level") == LEVELS[-1], F.col("n") / (F.col("n") + prior)).otherwise(1.0)
    return told.select("cycle", "node", "parent", "level", (F.col("_v") * weight + F.col("fallback") * (1 - weight)).alias("score"))


def learned_shares(known: DataFrame, cycle: str, **options) -> DataFrame:
    """``(cycle, node, parent, level, share)`` of one cycle: a model a level on the cycles that had closed when it
    opened, normalised among siblings."""
    rows = feature_rows(known).checkpoint()  # read for each level's fit
    query = rows.where(F.col("cycle") == cycle)
    closed = query.agg(F.max("closed")).first()[0]
    if closed is None:
        raise ValueError(f"nothing is known of cycle {cycle}")
    scores = [learned(rows.where((F.col("level") == level) & (F.col("idx") <= closed)), query.where(F.col("level") == level), "share", **options) for level in LEVELS[1:]]
    return normalized(reduce(DataFrame.unionByName, scores))


def learned_distribution(known: DataFrame, cycle: str, **options) -> DataFrame:
    """``(candidate, cycle, node, value)`` of one cycle: smoothed roots passed down by learned shares."""
    asked = known.where((F.col("cycle") == cycle) & F.col("state").isNotNull())
    return distributed(root_levels(known, asked), learned_shares(known, cycle, **options)).select(F.lit("topdown_ets_learned").alias("candidate"), "cycle", "node", "value")


def learned_backtest(known: DataFrame, origins: int, min_closed: int = MIN_CLOSED, **options) -> DataFrame:
    """``learned_distribution`` of the last ``origins`` cycles; three fits each."""
    cycles = [r.cycle for r in targets(known, min_closed, origins).select("cycle", "idx").distinct().orderBy("idx").collect()]
    if not cycles:
        raise ValueError(f"no cycle has {min_closed} closed ones before it")
    return reduce(DataFrame.unionByName, [learned_distribution(known, c, **options) for c in cycles])
