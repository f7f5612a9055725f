"""Daily series by distribution centre with outside indicators, and expanding windows to score them on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators.evaluate import ratio
from cyclecast.sources import quarterly

#: Days of the first training window, of a test window, and between their starts.
TRAIN, TEST, STEP = 180, 30, 30


def merged(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two quarterly tables with all keys of either."""
    return left.join(right, list(keys), "full_outer")


def state_features(census: DataFrame, quarters: DataFrame) -> DataFrame:
    """Census values of each state beside the means of its quarterly ones; a state may lack either."""
    values = [c for c in quarters.columns if c not in ("state", "q")]
    return merged(census, quarters.groupBy("state").agg(*(F.avg(c).alias(c) for c in values)), "state")


def attach(panel: DataFrame, features: DataFrame) -> DataFrame:
    """The states' features on each row; rows of states without any stay."""
    return panel.join(features, "state", "left")


def state_weights(base: DataFrame) -> DataFrame:
    """Each state's share of a CD's items."""
    sums = base.groupBy("cd", "state").agg(F.sum("items").alias("items"))
    return sums.select("cd", "state", ratio(F.col("items"), F.sum("items").over(Window.partitionBy("cd"))).alias("weight"))


def weighted(value: str) -> Column:
    """Weighted mean of what isn't null; null if nothing is."""
    return ratio(F.sum(F.col("weight") * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col("weight"))))


def cd_indicators(weights: DataFrame, quarters: DataFrame) -> DataFrame:
    """``(cd, q, ...)``: the states' quarterly values, weighted by what the CD sells there."""
    values = [c for c in quarters.columns if c not in ("state", "q")]
    return weights.join(quarters, "state").groupBy("cd", "q").agg(*(weighted(v).alias(v) for v in values))


def cd_series(base: DataFrame, indicators: DataFrame, lag: int = 2) -> DataFrame:
    """``(cd, date, y, ...)``: a CD's items by day, with its indicators of ``lag`` quarters before."""
    days = base.groupBy("cd", F.col("order_date").alias("date")).agg(F.sum("items").alias("y"))
    return quarterly.as_of(days, indicators, "cd", lag)


def folds(days: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP) -> DataFrame:
    """``(cd, fold, train_end, test_end)``: expanding windows from each CD's first day, whole test windows only."""
    ends = days.groupBy("cd").agg(F.min("date").alias("_a"), F.datediff(F.max("date"), F.min("date")).alias("_n"))
    last = F.floor((F.col("_n") + 1 - train - test) / step)
    rows = ends.where(last >= 0).select("cd", "_a", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold"))
    end = F.date_add("_a", (train - 1 + step * F.col("fold")).cast("int"))
    return rows.select("cd", "fold", end.alias("train_end"), F.date_add(end, test).alias("test_end"))


def varying(days: DataFrame, windows: DataFrame, regressors: list[str]) -> DataFrame:
    """``(cd, fold, regressor)`` of the regressors that aren't constant in the fold's training days."""
    rows = days.join(windows, "cd").where("date <= train_end").groupBy("cd", "fold").agg(*(F.count_distinct(r).alias(r) for r in regressors))
    pairs = F.array(*(F.struct(F.lit(r).alias("regressor"), F.col(r).alias("n")) for r in regressors))
    return rows.select("cd", "fold", F.explode(pairs).alias("p")).where("p.n > 1").select("cd", "fold", "p.regressor")


def test_days(days: DataFrame, windows: DataFrame) -> DataFrame:
    """The days after each fold's training, with how many days after it they are."""
    rows = days.join(windows, "cd").where("date > train_end and date <= test_end")
    return rows.withColumn("horizon", F.datediff("date", "train_end"))


def weekday_means(days: DataFrame, windows: DataFrame) -> DataFrame:
    """A forecast: the fold's training mean of the weekday, of all days where it has none."""
    past = days.join(windows, "cd").where("date <= train_end")
    own = past.groupBy("cd", "fold", F.weekday("date").alias("_w")).agg(F.avg("y").alias("_mean"))
    every = past.groupBy("cd", "fold").agg(F.avg("y").alias("_all"))
    rows = test_days(days, windows).withColumn("_w", F.weekday("date"))
    rows = rows.join(own, ["cd", "fold", "_w"], "left").join(every, ["cd", "fold"])
    return rows.select("cd", "fold", "date", "horizon", "y", F.coalesce("_mean", "_all").alias("predicted"))


def scored_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Errors by keys; the relative one is over the sum of |y|."""
    error = F.col("predicted") - F.col("y")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), ratio(F.sum(F.abs(error)), F.sum(F.abs(F.col("y")))).alias("wmape"))


def residual_means(rows: DataFrame, days: int = 7) -> DataFrame:
    """The mean residual of each CD's last ``days`` scored days; of a day in several folds, the nearest."""
    nearest = rows.groupBy("cd", "date").agg(F.min_by(F.col("predicted") - F.col("y"), "horizon").alias("residual"))
    run = Window.partitionBy("cd").orderBy("date").rowsBetween(1 - days, 0)
    return nearest.select("cd", "date", "residual", F.avg("residual").over(run).alias("residual_mean"))


def summary(rows: DataFrame) -> DataFrame:
    """By CD and model: days, and the daily values' mean, largest and deviation, with the mean error."""
    return rows.groupBy("cd", "model").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.max("y").alias("max"), F.stddev_samp("y").alias("std"), F.avg(F.abs(F.col("predicted") - F.col("y"))).alias("mae"))


def best_model(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("cd").agg(F.min_by("model", F.struct("mae", "model")).alias("model"), F.min("mae").alias("mae"))
