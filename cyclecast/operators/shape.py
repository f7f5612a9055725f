"""Curves of items within a window, and their spread over days and distribution centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators import calendar

BINS = 10
KEYS = ("sector", "cycle")


def bin_of(bins: int = BINS) -> Column:
    """Which equal part of its window a day falls in, in whole numbers."""
    return F.floor(F.col("offset") * bins / F.col("cycle_days")).cast("int").alias("bin")


def bin_shares(days: DataFrame, bins: int = BINS) -> DataFrame:
    """Per sector and bin: the mean over cycles with demand of the bin's share; a missing bin counts as 0."""
    positive = days.where("total_actual > 0")
    sums = positive.groupBy(*KEYS, bin_of(bins)).agg(F.sum(F.col("actual") / F.col("total_actual")).alias("share"))
    cycles = positive.groupBy("sector").agg(F.count_distinct("cycle").alias("_n"))
    grid = cycles.select("sector", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    each = sums.groupBy("sector", "bin").agg(F.sum("share").alias("_s"))
    return grid.join(each, ["sector", "bin"], "left").select("sector", "bin", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("share"))


def predict(shares: DataFrame, windows: DataFrame, bins: int = BINS) -> DataFrame:
    """Daily shares of each window (window_start, cycle_days): a bin's share split evenly over its days.

    Sums to 1 per window; where the curve has no mass there, or the sector no curve, uniform and flagged.
    """
    days = calendar.expand_days(windows).withColumn("bin", bin_of(bins))
    joined = days.join(shares, ["sector", "bin"], "left")
    weight = F.coalesce("share", F.lit(0.0)) / F.count("*").over(Window.partitionBy(*KEYS, "bin"))
    joined = joined.withColumn("_w", weight).withColumn("_t", F.sum("_w").over(Window.partitionBy(*KEYS)))
    share = F.when(F.col("_t") > 0, F.col("_w") / F.nullif("_t", F.lit(0.0))).otherwise(1.0 / F.col("cycle_days"))
    return joined.select(*KEYS, "date", "offset", share.alias("share_pred"), (F.col("_t") <= 0).alias("uniform_fallback"))


def normalize(shape: DataFrame) -> DataFrame:
    return shape.withColumn("share", F.col("share") / F.nullif(F.sum("share").over(Window.partitionBy("sector")), F.lit(0.0)))


def plain_average(observed: DataFrame) -> DataFrame:
    return normalize(observed.groupBy("sector", "offset").agg(F.avg("share").alias("share")))


def median(observed: DataFrame) -> DataFrame:
    return normalize(observed.groupBy("sector", "offset").agg(F.percentile("share", F.lit(0.5)).alias("share")))


def recency_weighted(observed: DataFrame, half_life: float = 2.0) -> DataFrame:
    """Weights halve every ``half_life`` cycles back from the last one."""
    last = observed.agg(F.max("cycle_idx").alias("_last"))
    weight = F.pow(F.lit(0.5), (F.col("_last") - F.col("cycle_idx")) / F.lit(half_life))
    rows = observed.crossJoin(F.broadcast(last)).withColumn("_w", weight)
    return normalize(rows.groupBy("sector", "offset").agg((F.sum(F.col("share") * F.col("_w")) / F.sum("_w")).alias("share")))


def last_cycle(observed: DataFrame) -> DataFrame:
    last = observed.agg(F.max("cycle_idx").alias("cycle_idx"))
    rows = observed.join(F.broadcast(last), "cycle_idx", "left_semi")
    return normalize(rows.groupBy("sector", "offset").agg(F.avg("share").alias("share")))


def shrunk(average: DataFrame, amount: float = 0.3) -> DataFrame:
    """Each sector's curve drawn towards the mean curve."""
    common = average.groupBy("offset").agg(F.avg("share").alias("_all"))
    joined = average.join(F.broadcast(common), "offset")
    return normalize(joined.select("sector", "offset", ((1 - amount) * F.col("share") + amount * F.col("_all")).alias("share")))


STRATEGIES = {"plain_average": plain_average, "median": median, "recency_weighted": recency_weighted, "last_cycle": last_cycle}


def observations(days: DataFrame) -> DataFrame:
    """Shares by offset of the days with orders, with their cycle's place in time."""
    order = days.groupBy("cycle").agg(F.min("window_start").alias("_d"))
    order = order.select("cycle", F.row_number().over(Window.orderBy("_d", "cycle")).alias("cycle_idx"))
    rows = days.where("actual > 0").select("sector", "cycle", "offset", (F.col("actual") / F.col("total_actual")).alias("share"))
    return rows.join(F.broadcast(order), "cycle")


def spread(predictions: DataFrame, windows: DataFrame, curve: DataFrame, cd_shares: DataFrame) -> DataFrame:
    """Items per sector, CD, cycle and date: cycle total x the day's weight x the CD's share."""
    weights = predict(curve, windows).select(*KEYS, "date", "share_pred")
    days = predictions.select(*KEYS, "items_pred").join(weights, list(KEYS)).join(cd_shares, "sector")
    return days.select("sector", "cd", "cycle", "date", (F.col("items_pred") * F.col("share_pred") * F.col("cd_share")).alias("pred"))


def score_daily(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecast against actual days of the forecast's sector-cycles; a side without a row counts as 0."""
    scope = forecast.select(*KEYS).distinct()
    actual = actuals.join(scope, list(KEYS), "left_semi").withColumnRenamed("items", "actual")
    return forecast.join(actual, ["sector", "cd", "cycle", "date"], "full_outer").fillna(0.0, ["pred", "actual"])


def error_by(daily: DataFrame, *keys: str) -> DataFrame:
    return daily.groupBy(*keys).agg(F.abs(F.sum("actual") - F.sum("pred")).alias("error"), F.sum("actual").alias("actual"))


def mean_of_means(daily: DataFrame, key: str) -> DataFrame:
    """Mean over ``key`` (sector or CD) of the mean error of its days."""
    return error_by(daily, key, "date").groupBy(key).agg(F.avg("error").alias("_e")).agg(F.avg("_e").alias("mae"))


def cd_day_wape(daily: DataFrame) -> DataFrame:
    return error_by(daily, "cd", "date").agg((F.sum("error") / F.nullif(F.sum("actual"), F.lit(0.0))).alias("wape"))


def curve_metrics(predicted: DataFrame, days: DataFrame) -> DataFrame:
    """Mean absolute share error in points, mean total variation per curve, fallbacks; days without a total are skipped."""
    rows = predicted.join(days.select(*KEYS, "date", "actual_share"), [*KEYS, "date"]).where("actual_share is not null")
    miss = F.abs(F.col("share_pred") - F.col("actual_share"))
    each = rows.groupBy(*KEYS).agg(F.avg(miss).alias("e"), (F.sum(miss) / 2).alias("tv"), F.max(F.col("uniform_fallback").cast("int")).alias("f"))
    return each.agg((100 * F.avg("e")).alias("share_mae_pp"), F.avg("tv").alias("total_variation"), F.sum("f").alias("fallbacks"), F.count("*").alias("curves"))


def cumulative(days: DataFrame) -> DataFrame:
    """Each window's share of items sold up to each day; null without demand."""
    run = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(*KEYS, "date", (F.sum("actual").over(run) / F.nullif(F.col("total_actual").cast("double"), F.lit(0.0))).alias("cumulative_share"))


def forecast_items(orders: DataFrame, items_per_order: DataFrame) -> DataFrame:
    """Forecast orders as items, by each sector's items an order."""
    return orders.join(items_per_order, "sector", "left").withColumn("forecast_items", F.col("forecast_orders") * F.col("items_per_order")).drop("items_per_order")
