"""Forecasts for scenario windows, combined by city and day, and their replay on past cycles.

A path is a set of windows ``(path, sector, cycle, window_start, window_end, emit)`` with the day it is
forecast from: only cycles that had closed by then are its history. Paths are rows, not jobs: a bridge
``(path, cycle)`` says what each may learn from, and one plan forecasts them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators import calendar, evaluate, folds, shape

#: What identifies a window of a series that is asked for.
WINDOW = ("serie", "cycle", "window_start", "cycle_days")
CITY = ("sector", "state", "city")


def _mean_of_last(n: int) -> Column:
    newest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("opening_date", F.col("items").cast("double").alias("x"))))), 1, n)
    return F.aggregate(newest, F.lit(0.0), lambda a, v: a + v["x"]) / F.size(newest)


def _per_day() -> Column:
    return F.avg(F.col("items") / F.pow(F.col("cycle_days").cast("double"), F.col("exponent")))


#: A series' level by strategy: an aggregate of its history. ``exponent`` is the history's own (see
#: ``folds.days_exponent``). Those of ``PER_DAY`` are for a window of one day, and grow with its length.
LEVELS: dict[str, Callable[[], Column]] = {
    "naive:mean": lambda: F.avg("items"),
    "naive:last": lambda: F.max_by("items", "opening_date").cast("double"),
    "moving_average": lambda: _mean_of_last(5),
    "window_scaled": _per_day,
}
PER_DAY = {"window_scaled"}


def answer(history: DataFrame, windows: DataFrame, levels: dict[str, Callable[[], Column]] = LEVELS) -> DataFrame:
    """``(candidate, *WINDOW, predicted)``: every window answered by all ``levels``, in one aggregation.

    A window of a series without history has null. History has to end before the first window's cycle.
    """
    span = history.agg(F.max("opening_date").alias("a")).crossJoin(windows.agg(F.min("opening_date").alias("b"))).first()
    if span.a and span.b and span.a >= span.b:
        raise ValueError(f"history reaches {span.a}, a window's cycle opens {span.b}")
    exponent = folds.days_exponent(history.withColumn("_one", F.lit(1)), ["_one"]).select("exponent")
    rows = history.crossJoin(F.broadcast(exponent))  # one row
    known = rows.groupBy("serie").agg(F.first("exponent").alias("exponent"), *(level().alias(f"_{i}") for i, level in enumerate(levels.values())))
    scale = F.pow(F.col("cycle_days").cast("double"), F.coalesce("exponent", F.lit(0.0)))
    each = [F.struct(F.lit(name).alias("candidate"), (F.col(f"_{i}") * (scale if name in PER_DAY else 1.0)).alias("predicted")) for i, name in enumerate(levels)]
    return windows.join(known, "serie", "left").select(*WINDOW, F.explode(F.array(*each)).alias("a")).select("a.candidate", *WINDOW, "a.predicted")


def attach(windows: DataFrame, told: DataFrame) -> DataFrame:
    """``windows`` with ``predicted`` of the same series, cycle, start and length in ``told``.

    Null where nothing is told; of several, the least, whatever their order.
    """
    return windows.join(told.groupBy(*WINDOW).agg(F.min("predicted").alias("predicted")), list(WINDOW), "left").select(*windows.columns, "predicted")


def future_targets(panel: DataFrame, cycles: list[str]) -> DataFrame:
    """Windows of ``cycles`` to come: those of the same cycles a year before, 52 weeks on.

    A sector that had none takes the cycle's opening and the median length of the others.
    """
    wanted = panel.sparkSession.createDataFrame([(c, f"{int(c[:4]) - 1}{c[4:]}") for c in cycles], "cycle string, _before string")
    known = panel.groupBy("sector", F.col("cycle").alias("_before")).agg(F.min("window_start").alias("_start"), F.min("cycle_days").alias("_days"))
    of_cycle = panel.groupBy(F.col("cycle").alias("_before")).agg(F.min("opening_date").alias("_opening"))
    medians = known.groupBy("_before").agg(F.percentile("_days", F.lit(0.5)).alias("_median"))
    asked = wanted.join(of_cycle, "_before").join(medians, "_before").crossJoin(panel.select("sector").distinct())  # a few cycles by the sectors
    rows = asked.join(known, ["sector", "_before"], "left")
    opening = F.date_add("_opening", 52 * 7)
    return rows.select("sector", "cycle", opening.alias("opening_date"), F.coalesce(F.date_add("_start", 52 * 7), opening).alias("window_start"), F.coalesce(F.col("_days").cast("double"), "_median").alias("cycle_days"))


# -- paths ------------------------------------------------------------------------------------------


def closed_history(cycles: DataFrame, paths: DataFrame, count: int) -> DataFrame:
    """``(path, cycle)``: the last ``count`` complete cycles closed before each path's ``as_of``.

    ``last_order`` of a path is the last day with orders before it: a cycle that ends later isn't complete.
    """
    seen = cycles.where("is_complete").crossJoin(F.broadcast(paths.select("path", "as_of", "last_order"))).where("closing_date < as_of and closing_date <= last_order")
    back = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("opening_date"), F.desc("cycle")))
    return seen.withColumn("_b", back).where(F.col("_b") <= count).select("path", "cycle", "opening_date")


def replay_paths(base: DataFrame, cycles: DataFrame, last: int) -> DataFrame:
    """``(path, as_of, last_order, opening)``: the last complete cycles, each forecast the day before it opens."""
    targets = cycles.where("is_complete").orderBy(F.desc("opening_date"), F.desc("cycle")).limit(last)
    targets = targets.select(F.col("cycle").alias("path"), F.date_sub("opening_date", 1).alias("as_of"), F.col("opening_date").alias("opening"))
    days = base.select("order_date").distinct().crossJoin(F.broadcast(targets)).where("order_date < as_of")
    return targets.join(days.groupBy("path").agg(F.max("order_date").alias("last_order")), "path")


def recorded_windows(base: DataFrame, cycles: DataFrame, paths: DataFrame, history: DataFrame) -> DataFrame:
    """The windows that were kept from the end of a path's history to its target, of sectors that have all."""
    ends = history.groupBy("path").agg(F.max("opening_date").alias("_last"))
    ahead = cycles.crossJoin(F.broadcast(paths.join(ends, "path"))).where("opening_date > _last and opening_date <= opening").select("path", "cycle")
    number = ahead.groupBy("path").agg(F.count("*").alias("_n"))
    windows = base.join(F.broadcast(ahead), "cycle").groupBy("path", "sector", "cycle").agg(F.min("opening_date").alias("window_start"), F.max("closing_date").alias("window_end"))
    whole = windows.groupBy("path", "sector").agg(F.count("*").alias("_k")).join(F.broadcast(number), "path").where("_k = _n").select("path", "sector")
    return windows.join(whole, ["path", "sector"], "left_semi").withColumn("emit", F.col("cycle") == F.col("path"))


def known_cities(panel: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, serie, sector, state, city)`` with a closed cycle before the path's ``as_of``."""
    firsts = panel.groupBy("serie", *CITY).agg(F.min("closing_date").alias("_first"))
    return firsts.crossJoin(F.broadcast(paths.select("path", "as_of"))).where("_first < as_of").select("path", "serie", *CITY)


def level_queries(windows: DataFrame, cities: DataFrame) -> DataFrame:
    """Each sector's window for every city known by then."""
    return windows.join(cities, ["path", "sector"]).withColumn("cycle_days", F.datediff("window_end", "window_start") + 1)


def path_levels(panel: DataFrame, history: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` with ``level_pred``, the mean of the path's history; null without any."""
    levels = panel.join(F.broadcast(history.select("path", "cycle")), "cycle").groupBy("path", "serie").agg(F.avg("items").alias("level_pred"))
    return queries.join(levels, ["path", "serie"], "left")


def path_shapes(days: DataFrame, history: DataFrame, windows: DataFrame) -> DataFrame:
    """``(path, sector, cycle, date, offset, share_pred, uniform_fallback)``: each path's own curves."""
    key = F.struct("path", "sector")
    train = days.join(F.broadcast(history.select("path", "cycle")), "cycle").withColumn("sector", key)
    asked = windows.select(key.alias("sector"), "cycle", "window_start", (F.datediff("window_end", "window_start") + 1).alias("cycle_days"))
    found = shape.predict(shape.bin_shares(train), asked)
    return found.select("sector.path", "sector.sector", *(c for c in found.columns if c != "sector"))


def combine(levels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Daily items of each city: its total times its sector's share of the day."""
    days = levels.join(shapes, ["path", "sector", "cycle"])
    return days.select("path", *CITY, "cycle", "date", (F.datediff("date", "window_start") + 1).alias("relative_day"), (F.col("level_pred") * F.col("share_pred")).alias("items_pred"), "uniform_fallback")


def combined(panel: DataFrame, days: DataFrame, cycles: DataFrame, paths: DataFrame, windows: DataFrame, history_cycles: int) -> DataFrame:
    """The emitted days of all paths ``(path, as_of, last_order)`` with their ``windows``."""
    history = closed_history(cycles, paths, history_cycles)
    emitted = windows.where("emit").drop("emit")
    levels = path_levels(panel, history, level_queries(emitted, known_cities(panel, paths)))
    return combine(levels, path_shapes(days, history, emitted))


def replay(base: DataFrame, panel: DataFrame, days: DataFrame, last: int = 3, history_cycles: int = 10) -> DataFrame:
    """Past cycles forecast as of the day before they opened, beside what came: city by city, day by day.

    Days without orders are 0; demand that no model predicted stays, with a null prediction.
    """
    cycles = calendar.cycle_calendar(base)
    paths = replay_paths(base, cycles, last)
    windows = recorded_windows(base, cycles, paths, closed_history(cycles, paths, history_cycles))
    windows = windows.join(known_cities(panel, paths).select("path", "sector").distinct(), ["path", "sector"], "left_semi")
    daily = combined(panel, days, cycles, paths, windows, history_cycles).select("path", *CITY, "date", "items_pred")
    scope = windows.where("emit").select("path", "sector", "cycle")
    actual = base.join(scope, ["sector", "cycle"]).groupBy("path", *CITY, F.col("order_date").alias("date")).agg(F.sum("items").cast("double").alias("actual"))
    both = daily.join(actual, ["path", *CITY, "date"], "full_outer").fillna(0.0, ["actual"])
    error = F.col("items_pred") - F.col("actual")
    return both.select(F.col("path").alias("target_cycle"), *CITY, "date", "items_pred", "actual", F.col("items_pred").isNotNull().alias("prediction_available"), error.alias("error"), F.abs(error).alias("abs_error"))


def replay_metrics() -> list[Column]:
    """Errors of the days that were predicted, and what no prediction covers."""
    told = F.col("prediction_available")
    actual = F.when(told, F.col("actual"))
    return [
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), evaluate.ratio(F.sum("abs_error"), F.sum(actual)).alias("wmape"),
        F.avg("error").alias("bias"), (100 * evaluate.ratio(F.sum("error"), F.sum(actual))).alias("bias_pct"), F.count_if(told).alias("n_scored_days"), F.count_if(~told).alias("n_unpredicted_rows"),
        F.coalesce(F.sum(F.when(~told, F.col("actual"))), F.lit(0.0)).alias("unpredicted_actual_items"), evaluate.ratio(F.sum(actual), F.sum("actual")).alias("actual_volume_coverage"),
    ]


def summarize_replay(rows: DataFrame) -> DataFrame:
    """All cycles together (``ALL``) and each: one aggregation for both."""
    found = rows.rollup("target_cycle").agg(*replay_metrics(), F.grouping("target_cycle").alias("_all"))
    scope = F.when(F.col("_all") == 1, "overall").otherwise("cycle")
    return found.select(scope.alias("scope"), F.coalesce("target_cycle", F.lit("ALL")).alias("cycle"), *(c for c in found.columns if c not in ("target_cycle", "_all")))


def summarize_cities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("target_cycle", *CITY).agg(*replay_metrics())
