"""Level strategies for totals per sector and cycle, several steps ahead, and their scoreboard.

``totals(sector, cycle_id, cycle_total)`` with consecutive integer cycle ids. Trend and calendar
regression are sums of products in one aggregation; smoothing and the differenced autoregression are
small fits per sector, with sectors dealt over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = tuple(round(0.05 * i, 2) for i in range(1, 21))


def _steps(rows: DataFrame, steps: list[int]) -> DataFrame:
    return rows.withColumn("step", F.explode(F.array(*(F.lit(s) for s in steps))))


def _answer(rows: DataFrame, name: str, value: Column, last: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("strategy"), "sector", (last + F.col("step")).cast("long").alias("cycle_id"), F.greatest(value, F.lit(0.0)).alias("forecast_cycle_total"))


def _with_last(totals: DataFrame) -> DataFrame:
    """The last cycle of all sectors, on a row of its own."""
    return totals.agg(F.max("cycle_id").alias("last_cycle"))


def naive_last(totals: DataFrame, steps: list[int]) -> DataFrame:
    """The last observed total, for every step."""
    rows = totals.groupBy("sector").agg(F.max_by("cycle_total", "cycle_id").cast("double").alias("y")).crossJoin(F.broadcast(_with_last(totals)))
    return _answer(_steps(rows, steps), "naive_last", F.col("y"), F.col("last_cycle"))


def linear_trend(totals: DataFrame, steps: list[int]) -> DataFrame:
    """The last total carried on with the slope of a least-squares line over the order of cycles.

    One total alone has slope 0; results are never negative.
    """
    from pyspark.sql import Window

    ranked = totals.withColumn("x", F.row_number().over(Window.partitionBy("sector").orderBy("cycle_id")).cast("double"))
    rows = ranked.groupBy("sector").agg(F.max_by("cycle_total", "cycle_id").cast("double").alias("y"), F.coalesce(F.regr_slope(F.col("cycle_total").cast("double"), "x"), F.lit(0.0)).alias("slope"))
    rows = rows.crossJoin(F.broadcast(_with_last(totals)))
    return _answer(_steps(rows, steps), "linear_trend", F.col("y") + F.col("slope") * F.col("step"), F.col("last_cycle"))


def calendar_regression(totals: DataFrame, cycles: DataFrame, steps: list[int]) -> DataFrame:
    """Least squares on a constant, the cycle's number and the month of its opening.

    ``cycles(cycle_id, open_date)`` has history and future. The normal equations are centred sums; a
    column that doesn't vary beside the others (a determinant of nothing) is left out.
    """
    rows = totals.join(F.broadcast(cycles), "cycle_id").select("sector", F.col("cycle_id").cast("double").alias("a"), F.month("open_date").cast("double").alias("b"), F.col("cycle_total").cast("double").alias("y"))
    sums = rows.groupBy("sector").agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("y").alias("my"),
        F.coalesce(F.regr_sxx("a", "a"), F.lit(0.0)).alias("aa"), F.coalesce(F.regr_sxx("b", "b"), F.lit(0.0)).alias("bb"),
        F.coalesce(F.regr_sxy("a", "b"), F.lit(0.0)).alias("ab"), F.coalesce(F.regr_sxy("y", "a"), F.lit(0.0)).alias("ay"), F.coalesce(F.regr_sxy("y", "b"), F.lit(0.0)).alias("by"),
    ).crossJoin(F.broadcast(_with_last(totals)))
    full = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    usable = full > 1e-9 * F.greatest(F.col("aa") * F.col("bb"), F.lit(1e-300))
    on_a = F.when(usable, (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / full).when(F.col("aa") > 0, F.col("ay") / F.col("aa")).otherwise(0.0)
    on_b = F.when(usable, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / full).when((F.col("aa") <= 0) & (F.col("bb") > 0), F.col("by") / F.col("bb")).otherwise(0.0)
    future = F.broadcast(cycles.select(F.col("cycle_id").alias("_to"), F.month("open_date").cast("double").alias("_month")))
    asked = _steps(sums, steps).join(future, F.col("_to") == F.col("last_cycle") + F.col("step"))
    value = F.col("my") + on_a * (F.col("_to") - F.col("ma")) + on_b * (F.col("_month") - F.col("mb"))
    return asked.select(F.lit("calendar_regression").alias("strategy"), "sector", F.col("_to").cast("long").alias("cycle_id"), F.greatest(value, F.lit(0.0)).alias("forecast_cycle_total"))


def smoothed(values: np.ndarray, steps: list[int], damping: float = 1.0) -> list[float]:
    """Linear-trend smoothing (Holt; damped below 1), its two weights those of least squared one-step error."""
    if len(values) < 3:
        return [float(values[-1])] * len(steps)
    grid = np.array([(a, a * b) for a in WEIGHTS for b in (0.0, *WEIGHTS)])
    level, trend = np.full(len(grid), values[0]), np.full(len(grid), values[1] - values[0])
    error = np.zeros(len(grid))
    for y in values[1:]:
        miss = y - level - damping * trend
        error += miss**2
        level, trend = level + damping * trend + grid[:, 0] * miss, damping * trend + grid[:, 1] * miss
    best = int(error.argmin())
    return [float(level[best] + trend[best] * sum(damping**i for i in range(1, s + 1))) for s in steps]


def differenced_autoregression(values: np.ndarray, steps: list[int]) -> list[float]:
    """ARIMA(1, 1, 0) by conditional least squares, the coefficient kept within one."""
    change = np.diff(values)
    if len(change) < 2 or not (change[:-1] ** 2).sum():
        return [float(values[-1])] * len(steps)
    phi = float(np.clip((change[1:] * change[:-1]).sum() / (change[:-1] ** 2).sum(), -1, 1))
    return [float(values[-1] + change[-1] * sum(phi**i for i in range(1, s + 1))) for s in steps]


def fitted_per_sector(totals: DataFrame, name: str, fit, steps: list[int]) -> DataFrame:
    """``fit(values, steps)`` for each sector's totals in the order of cycles; no value below 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cycle_id")
        out = fit(rows["cycle_total"].to_numpy(float), steps)
        return pd.DataFrame({"strategy": name, "sector": rows["sector"].iloc[0], "step": steps, "forecast_cycle_total": np.maximum(out, 0.0)})

    found = totals.groupBy("sector").applyInPandas(run, "strategy string, sector string, step long, forecast_cycle_total double")
    found = found.crossJoin(F.broadcast(_with_last(totals)))
    return found.select("strategy", "sector", (F.col("last_cycle") + F.col("step")).cast("long").alias("cycle_id"), "forecast_cycle_total")


def forecast_all(totals: DataFrame, cycles: DataFrame, steps: list[int]) -> DataFrame:
    """All five strategies."""
    return (
        naive_last(totals, steps)
        .unionByName(linear_trend(totals, steps))
        .unionByName(calendar_regression(totals, cycles, steps))
        .unionByName(fitted_per_sector(totals, "holt", smoothed, steps))
        .unionByName(fitted_per_sector(totals, "arima_110", differenced_autoregression, steps))
    )


def scoreboard(forecasts: DataFrame, actual: DataFrame) -> DataFrame:
    """Errors of each strategy on ``actual(sector, cycle_id, cycle_total)``, best first by ``place``."""
    from pyspark.sql import Window

    rows = forecasts.join(actual, ["sector", "cycle_id"]).select("strategy", (F.col("forecast_cycle_total") - F.col("cycle_total")).alias("e"), F.col("cycle_total").alias("y"))
    found = rows.groupBy("strategy").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.try_divide(F.sum(F.abs("e")), F.sum("y")).alias("wmape"), F.avg("e").alias("bias"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("mae", "strategy")))
