"""Metrics, common points and rankings of scored points (candidate, serie, cycle, origin, actual, predicted, abs_error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ("serie", "cycle", "origin")


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def metrics() -> list[Column]:
    error = F.col("predicted") - F.col("actual")
    return [
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("point_mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        (100 * ratio(F.sum(error), F.sum("actual"))).alias("bias_pct"), ratio(F.sum(F.abs(error)), F.sum("actual")).alias("wmape"),
        F.percentile("abs_error", F.lit(0.9)).alias("p90"),
    ]


def equal_weight_mae(points: DataFrame) -> DataFrame:
    """Per candidate: the mean of its series' mean errors."""
    return points.groupBy("candidate", "serie").agg(F.avg("abs_error").alias("_e")).groupBy("candidate").agg(F.avg("_e").alias("mae"), F.count("*").alias("series"))


def worst_origin(points: DataFrame) -> DataFrame:
    each = points.groupBy("candidate", "origin").agg(F.avg("abs_error").alias("mae"))
    return each.groupBy("candidate").agg(F.max_by("origin", F.struct("mae", "origin")).alias("origin"), F.max("mae").alias("mae"))


def naive_scale(train: DataFrame) -> DataFrame:
    """Per origin: mean absolute change from one cycle to the next within the training series."""
    from pyspark.sql import Window

    change = F.abs(F.col("items") - F.lag("items").over(Window.partitionBy("origin", "serie").orderBy("opening_date")))
    return train.select("origin", change.alias("c")).groupBy("origin").agg(F.avg("c").alias("scale"))


def mase(points: DataFrame, scales: DataFrame) -> DataFrame:
    """Mean over origins of error over scale on ``points``, the common ones; infinite where the scale is 0."""
    each = points.groupBy("candidate", "origin").agg(F.avg("abs_error").alias("mae")).join(scales, "origin")
    value = F.when(F.col("scale") == 0, F.lit(float("inf"))).otherwise(F.col("mae") / F.nullif("scale", F.lit(0.0)))
    return each.groupBy("candidate").agg(F.avg(value).alias("mase"))


def common_points(points: DataFrame) -> DataFrame:
    """The points that every candidate scored: one count per point instead of an intersection each."""
    total = points.agg(F.count_distinct("candidate").alias("_all"))
    shared = points.groupBy(*POINT).agg(F.count_distinct("candidate").alias("_n")).crossJoin(F.broadcast(total)).where("_n = _all")
    return points.join(shared.select(*POINT), list(POINT), "left_semi")


def compare(points: DataFrame) -> DataFrame:
    """Candidates on common points, best mean error first, with their own coverage. The points are made once."""
    points = points.checkpoint()
    own = points.groupBy("candidate").agg(F.count("*").alias("own_points"))
    shared = common_points(points)
    table = equal_weight_mae(shared).join(shared.groupBy("candidate").agg(*metrics()), "candidate").join(own, "candidate")
    return table.orderBy("mae", "candidate")


def by_dimension(points: DataFrame, dimension: str) -> DataFrame:
    return points.groupBy("candidate", dimension).agg(*metrics())


def volume_bands(points: DataFrame) -> DataFrame:
    """Errors by thirds of the series' mean volume, and the share of points forecast too low."""
    sizes = points.groupBy("serie").agg(F.avg("actual").alias("size"))
    cuts = sizes.agg(F.percentile("size", F.lit(0.33)).alias("a"), F.percentile("size", F.lit(0.66)).alias("b"))
    band = F.when(F.col("size") <= F.col("a"), "low").when(F.col("size") <= F.col("b"), "mid").otherwise("high")
    named = sizes.crossJoin(F.broadcast(cuts)).select("serie", band.alias("band"))
    under = F.avg((F.col("predicted") < F.col("actual")).cast("double")).alias("frac_under")
    return points.join(named, "serie").groupBy("candidate", "band").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), under)


def log_sigma(points: DataFrame, horizons: int = 3) -> DataFrame:
    """Deviation of log(actual / predicted) of the cycles' totals, and the 95 % bands 1 to ``horizons``
    cycles ahead, which grow with the root of the horizon."""
    totals = points.groupBy("candidate", "cycle").agg(F.sum("actual").alias("a"), F.sum("predicted").alias("p")).where("a > 0 and p > 0")
    sigma = totals.groupBy("candidate").agg(F.stddev_samp(F.log(F.col("a") / F.col("p"))).alias("sigma"))
    rows = sigma.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    wide = 1.96 * F.col("sigma") * F.sqrt("horizon")
    return rows.select("candidate", "horizon", "sigma", F.exp(-wide).alias("low"), F.exp(wide).alias("high"))
