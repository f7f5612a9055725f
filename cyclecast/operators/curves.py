"""Curves within the window scored from cycle to cycle, and one that is learned."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators import calendar, shape
from cyclecast.operators.evaluate import ratio

KEYS = ("sector", "cycle")


def ordered(days: DataFrame) -> DataFrame:
    """``(cycle, origin)``: the cycles' places in time, from 1."""
    found = days.groupBy("cycle").agg(F.min("window_start").alias("_d"))
    return found.select("cycle", F.row_number().over(Window.orderBy("_d", "cycle")).alias("origin"))


def backtest(days: DataFrame, candidate: str, bins: int = shape.BINS, min_train: int = 20, sliding: bool = False) -> DataFrame:
    """Every cycle's days after the first ``min_train``, forecast from the curves of the cycles before it.

    Bins are summed once per sector and cycle; what an origin knows are running sums over them, so all
    origins are one pass. ``sliding``: only the last ``min_train`` cycles count.
    """
    placed = days.join(F.broadcast(ordered(days)), "cycle").withColumn("bin", shape.bin_of(bins))
    since = -min_train if sliding else Window.unboundedPreceding
    share = F.sum(F.when(F.col("total_actual") > 0, F.col("actual") / F.col("total_actual")).otherwise(0.0))
    sums = placed.groupBy("sector", "origin", "bin").agg(share.alias("s"))
    known = F.sum("s").over(Window.partitionBy("sector", "bin").orderBy("origin").rangeBetween(since, -1))
    cycles = placed.groupBy("sector", "origin").agg(F.max((F.col("total_actual") > 0).cast("int")).alias("p"))
    counted = F.sum("p").over(Window.partitionBy("sector").orderBy("origin").rangeBetween(since, -1))
    curve = sums.select("sector", "origin", "bin", known.alias("s")).join(cycles.select("sector", "origin", counted.alias("n")), ["sector", "origin"])
    rows = placed.where(F.col("origin") > min_train).join(curve.select("sector", "origin", "bin", ratio(F.col("s"), F.col("n")).alias("share")), ["sector", "origin", "bin"])
    rows = rows.withColumn("w", F.coalesce("share", F.lit(0.0)) / F.count("*").over(Window.partitionBy("sector", "origin", "bin"))).withColumn("t", F.sum("w").over(Window.partitionBy("sector", "origin")))
    told = F.when(F.col("t") > 0, F.col("w") / F.nullif("t", F.lit(0.0))).otherwise(1.0 / F.col("cycle_days"))
    return _scored(rows.withColumn("share_pred", told).withColumn("uniform_fallback", F.col("t") <= 0), candidate)


def _scored(rows: DataFrame, candidate: str) -> DataFrame:
    rows = rows.withColumn("error", F.col("share_pred") * F.col("total_actual") - F.col("actual"))
    return rows.select(
        F.lit(candidate).alias("candidate"), "origin", *KEYS, "date", "share_pred", "uniform_fallback", F.col("actual").cast("double").alias("actual"), "total_actual", "error",
        F.abs(F.col("share_pred") - F.col("actual") / F.nullif(F.col("total_actual").cast("double"), F.lit(0.0))).alias("abs_share_error"),
    )


def compare(points: DataFrame) -> DataFrame:
    """Per candidate: share errors, each sector-cycle weighing the same, and daily ones; best first by ``place``,
    candidates without any share error last."""
    curve = points.groupBy("candidate", "origin", *KEYS).agg(
        F.avg("abs_share_error").alias("m"), F.sum("abs_share_error").alias("v"), F.max(F.col("total_actual") <= 0).alias("zero"), F.max("uniform_fallback").alias("flat"),
        F.sum(F.abs("error")).alias("ae"), F.sum(F.col("error") * F.col("error")).alias("se"), F.sum("error").alias("e"), F.sum("actual").alias("a"), F.count("*").alias("d"),
    )
    days = F.sum("d")
    found = curve.groupBy("candidate").agg(
        (100 * F.avg("m")).alias("share_mae_pp"), (0.5 * F.avg("v")).alias("total_variation"), (F.sum("ae") / days).alias("mae"), F.sqrt(F.sum("se") / days).alias("rmse"), (F.sum("e") / days).alias("bias"),
        ratio(F.sum("ae"), F.sum("a")).alias("wmape"), days.alias("n_days"), F.count("*").alias("n_sector_cycles"), F.count_if("zero").alias("n_zero_total_cycles"),
        F.count_if("flat").alias("n_uniform_fallback_cycles"), F.count_distinct("origin").alias("n_origins"),
    )
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("share_mae_pp"), "candidate")))


#: Strategies by name: bins of the curve, and whether only recent cycles count.
STRATEGIES = {f"bins:{n}{':sliding' if s else ''}": (n, s) for n in (5, 10, 20) for s in (False, True)}


def sweep(days: DataFrame, min_train: int = 20) -> DataFrame:
    """The back-tests of all ``STRATEGIES``."""
    found = None
    for name, (bins, sliding) in STRATEGIES.items():
        own = backtest(days, name, bins, min_train, sliding)
        found = own if found is None else found.unionByName(own)
    return found


def learned(history: DataFrame, windows: DataFrame, trees: int = 20) -> DataFrame:
    """``(sector, cycle, date, offset, share_pred, uniform_fallback)`` by boosted trees.

    They learn a day's intensity, its share times the window's length, from its place in the window,
    weekday, month and sector; days weigh one over their window's length. Predictions are cut at 0 and
    made to add up to 1 a window; a window with none is uniform. Sectors that history lacks are one more.
    """
    features = ["position", "weekday", "month", "cycle_days", "sector_code"]

    def table(days: DataFrame) -> DataFrame:
        return days.withColumns({"position": (F.col("offset") + 0.5) / F.col("cycle_days"), "weekday": F.weekday("date").cast("double"), "month": F.month("date").cast("double")})

    train = table(history.where("total_actual > 0")).withColumns({"label": F.col("actual") / F.col("total_actual") * F.col("cycle_days"), "weight": 1.0 / F.col("cycle_days")})
    asked = table(calendar.expand_days(windows))
    codes = StringIndexer(inputCol="sector", outputCol="sector_code", handleInvalid="keep").fit(train)
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    bins = max(64, len(codes.labels) + 1)  # a bin for each sector
    model = GBTRegressor(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.1, maxBins=bins, seed=42).fit(assemble.transform(codes.transform(train)))
    told = model.transform(assemble.transform(codes.transform(asked))).withColumn("w", F.greatest("prediction", F.lit(0.0)))
    told = told.withColumn("t", F.sum("w").over(Window.partitionBy(*KEYS)))
    share = F.when(F.col("t") > 0, F.col("w") / F.nullif("t", F.lit(0.0))).otherwise(1.0 / F.col("cycle_days"))
    return told.select(*KEYS, "date", "offset", share.alias("share_pred"), (F.col("t") <= 0).alias("uniform_fallback"))
