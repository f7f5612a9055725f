"""The pair of a level and a curve that forecasts days best on cycles held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators.evaluate import ratio


def sector_levels(totals: DataFrame, holdout: int) -> DataFrame:
    """``(level, sector, cycle, origin, value)`` for the last ``holdout`` cycles of ``totals(sector, cycle, origin, total)``,
    from what came before the first of them: the last total, the mean, and the mean of the last five."""
    last = totals.agg((F.max("origin") - holdout).alias("_cut"))
    split = totals.crossJoin(F.broadcast(last))  # one row
    back = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("origin")))
    known = split.where(F.col("origin") <= F.col("_cut")).withColumn("_b", back)
    value = lambda n: F.avg(F.when(F.col("_b") <= n, F.col("total")))
    levels = known.groupBy("sector").agg(value(1).alias("last"), F.avg("total").alias("mean"), value(5).alias("mean_5"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(n).cast("double").alias("value")) for n in ("last", "mean", "mean_5"))))
    asked = split.where(F.col("origin") > F.col("_cut")).select("sector", "cycle", "origin")
    return asked.join(levels, "sector").select("sector", "cycle", "origin", each.alias("e")).select("e.level", "sector", "cycle", "origin", "e.value")


def pairs(levels: DataFrame, curves: DataFrame, actual: DataFrame) -> DataFrame:
    """Every level with every curve, best first by ``place``: errors of the daily totals over all sectors.

    ``curves(curve, sector, cycle, date, share_pred)``, ``actual(date, actual)``. A day that only one side has
    counts as 0 on the other. Ties go to the names.
    """
    days = levels.join(curves, ["sector", "cycle"]).groupBy("level", "curve", "date").agg(F.sum(F.col("value") * F.col("share_pred")).alias("forecast"))
    names = levels.select("level").distinct().crossJoin(F.broadcast(curves.select("curve").distinct()))  # a few
    seen = actual.crossJoin(F.broadcast(names))
    both = days.join(seen, ["level", "curve", "date"], "full_outer").fillna(0.0, ["forecast", "actual"])
    miss = F.abs(F.col("forecast") - F.col("actual"))
    found = both.groupBy("level", "curve").agg(F.avg(miss).alias("mae"), ratio(F.sum(miss), F.sum("actual")).alias("wmape"), F.count("*").alias("n_days"))
    order = Window.orderBy(F.asc_nulls_last(F.round("wmape", 9)), "level", "curve")
    return found.withColumn("place", F.row_number().over(order).cast("long"))


def best(scored: DataFrame) -> DataFrame:
    """One row: the first of ``pairs``."""
    return scored.where("place = 1").select("level", "curve", "mae", "wmape")
