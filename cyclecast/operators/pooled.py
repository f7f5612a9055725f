"""Pooled learners over all series: boosting that stops by cycle and goes on by itself, and quantiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators import features, folds

INPUTS = ["items_lag_1", "items_lag_2", "items_lag_3", "items_lag_4", "items_mean_3", "items_mean_6", "level_ref", "orders_lag_1", "volumes_lag_1", "items_per_order_lag_1", "days_since_previous", "cycle_number", "cycle_days"]
#: What a future cycle doesn't know once the one before it is a forecast, too.
OBSERVED = ["orders_lag_1", "volumes_lag_1", "items_per_order_lag_1"]
KEPT = 6


def _flagged(rows: DataFrame) -> DataFrame:
    """The inputs as doubles, each with a flag where it is missing."""
    rows = rows.withColumns({c: F.col(c).cast("double") for c in INPUTS})
    return rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in INPUTS})


def training_rows(panel: DataFrame) -> DataFrame:
    """``(serie, cycle, idx, actual, inputs, flags)`` of the rows whose series had sold before."""
    index = folds.cycle_index(panel).select("cycle", "idx")
    rows = features.build(panel).select("serie", "cycle", F.col("items").cast("double").alias("actual"), *INPUTS).where("level_ref > 0")
    return _flagged(rows).join(F.broadcast(index), "cycle")


@dataclass(frozen=True)
class Boosted:
    """A fitted model: medians for what is missing, and trees on items over the series' mean so far."""

    filler: ImputerModel
    model: GBTRegressionModel

    @property
    def trees(self) -> int:
        return self.model.getNumTrees

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (flagged inputs) with ``predicted``."""
        told = self.model.transform(_assembler().transform(self.filler.transform(rows)))
        return told.withColumn("predicted", F.greatest(F.col("prediction") * F.col("level_ref"), F.lit(0.0))).drop("prediction", "features")


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=INPUTS + [f"{c}_missing" for c in INPUTS], outputCol="features")


def fit(rows: DataFrame, most: int = 60, validation: int = 4, depth: int = 4, tolerance: float = 0.01) -> Boosted:
    """Boosted trees on absolute error, no more than further ones help on the last ``validation`` cycles.

    Those cycles are not learnt from; 0 of them fits all ``most`` trees to all rows. Medians come from
    the rows that are learnt from alone.
    """
    last = rows.agg(F.max("idx")).first()[0]
    if last is None:
        raise ValueError("no series has sold before")
    held = F.col("idx") > last - validation
    filler = Imputer(inputCols=INPUTS, outputCols=INPUTS, strategy="median").fit(rows.where(~held) if validation else rows)
    table = _assembler().transform(filler.transform(rows)).withColumns({"label": F.col("actual") / F.col("level_ref"), "held": held})
    learner = GBTRegressor(labelCol="label", lossType="absolute", maxIter=most, maxDepth=depth, stepSize=0.1, seed=0)
    if validation:
        learner = learner.setValidationIndicatorCol("held").setParams(validationTol=tolerance)
    return Boosted(filler, learner.fit(table))


# -- cycles to come, one after another ---------------------------------------------------------------


def series_state(panel: DataFrame) -> DataFrame:
    """``(serie, recent, total, n, last_start, orders, volumes)``: what the next cycle's inputs are made from.

    ``recent``: the last items, newest first.
    """
    rows = F.array_sort(F.collect_list(F.struct("opening_date", F.col("items").cast("double").alias("x"), F.col("orders").cast("double").alias("orders"), F.col("volumes").cast("double").alias("volumes"), "window_start")))
    found = panel.groupBy("serie").agg(rows.alias("s"), F.sum(F.col("items").cast("double")).alias("total"), F.count("*").alias("n"))
    last = F.element_at("s", -1)
    return found.select("serie", F.slice(F.reverse(F.transform("s", lambda v: v["x"])), 1, KEPT).alias("recent"), "total", "n", last["window_start"].alias("last_start"), last["orders"].alias("orders"), last["volumes"].alias("volumes"))


def state_inputs(asked: DataFrame) -> DataFrame:
    """Inputs of ``asked(serie, cycle, window_start, cycle_days, and the state)``."""
    mean = lambda n: F.when(F.size("recent") >= n, F.aggregate(F.slice("recent", 1, n), F.lit(0.0), lambda a, x: a + x) / n)
    new: dict[str, Column] = {f"items_lag_{i}": F.get("recent", F.lit(i - 1)) for i in (1, 2, 3, 4)} | {f"items_mean_{n}": mean(n) for n in (3, 6)}
    new |= {"level_ref": F.col("total") / F.nullif("n", F.lit(0)), "orders_lag_1": F.col("orders"), "volumes_lag_1": F.col("volumes"), "items_per_order_lag_1": F.get("recent", F.lit(0)) / F.nullif("orders", F.lit(0.0))}
    new |= {"days_since_previous": F.datediff("window_start", "last_start"), "cycle_number": F.right("cycle", F.lit(2)).cast("int")}
    return _flagged(asked.withColumns(new))


def path(model: Boosted, panel: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows(scenario, serie, cycle, opening_date, window_start, cycle_days)`` with ``predicted``, cycle after cycle.

    A cycle's forecasts, averaged over its scenarios, are the next one's last items; the earliest of its
    starts is the last start; orders and volumes aren't known any more. What really came is never used.
    Series without history have no forecast. The state, a row a series, is checkpointed a cycle.
    """
    cycles = [r.cycle for r in windows.groupBy("cycle").agg(F.min("opening_date").alias("d")).orderBy("d", "cycle").collect()]  # a few
    state, found = series_state(panel).checkpoint(), []
    for cycle in cycles:
        asked = windows.where(F.col("cycle") == cycle).join(state, "serie")
        told = model.predict(state_inputs(asked)).select(*windows.columns, "predicted").checkpoint()
        found.append(told)
        mean = told.groupBy("serie").agg(F.avg("predicted").alias("_x"), F.min("window_start").alias("_start"))
        new = F.col("_x").isNotNull()
        none = F.lit(None).cast("double")
        state = state.join(mean, "serie", "left").select(
            "serie", F.when(new, F.slice(F.concat(F.array("_x"), "recent"), 1, KEPT)).otherwise(F.col("recent")).alias("recent"), (F.col("total") + F.coalesce("_x", F.lit(0.0))).alias("total"), (F.col("n") + new.cast("long")).alias("n"),
            F.coalesce("_start", "last_start").alias("last_start"), F.when(~new, F.col("orders")).otherwise(none).alias("orders"), F.when(~new, F.col("volumes")).otherwise(none).alias("volumes"),
        ).checkpoint()
    return reduce(DataFrame.unionByName, found) if found else windows.withColumn("predicted", F.lit(None).cast("double"))


# -- quantiles --------------------------------------------------------------------------------------


#: Inputs in items, which the linear model sees over the series' mean so far, like its target.
IN_ITEMS = ["items_lag_1", "items_lag_2", "items_lag_3", "items_lag_4", "items_mean_3", "items_mean_6"]


def _relative(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c) / F.col("level_ref") for c in IN_ITEMS})


@dataclass(frozen=True)
class Quantile:
    """A linear quantile of items over the series' mean so far."""

    filler: ImputerModel
    model: LinearRegressionModel
    shift: float

    def predict(self, rows: DataFrame) -> DataFrame:
        told = self.model.transform(_assembler().transform(self.filler.transform(_relative(rows))))
        return told.withColumn("predicted", F.greatest((F.col("prediction") + self.shift) * F.col("level_ref"), F.lit(0.0))).drop("prediction", "features")


def fit_quantile(rows: DataFrame, alpha: float, rounds: int = 12) -> Quantile:
    """The ``alpha`` quantile by least squares that are weighted anew in each round (pinball loss).

    A row weighs alpha, or 1 - alpha where it lies below, over its distance; a round is one distributed
    pass that sums the normal equations. At last a shift puts ``alpha`` of the rows below.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    rows = _relative(rows)
    filler = Imputer(inputCols=INPUTS, outputCols=INPUTS, strategy="median").fit(rows)
    table = _assembler().transform(filler.transform(rows)).select("features", (F.col("actual") / F.col("level_ref")).alias("label")).checkpoint()
    now, model = table.withColumn("w", F.lit(1.0)), None
    for _ in range(rounds):
        model = LinearRegression(weightCol="w", solver="normal", regParam=1e-4).fit(now)
        miss = F.col("label") - F.col("prediction")
        now = model.transform(table).withColumn("w", F.when(miss > 0, alpha).otherwise(1 - alpha) / F.greatest(F.abs(miss), F.lit(1e-3))).drop("prediction")
    left = model.transform(table).agg(F.percentile_approx(F.col("label") - F.col("prediction"), alpha, F.lit(100_000))).first()[0]
    return Quantile(filler, model, float(left or 0.0))


def coverage(told: DataFrame) -> DataFrame:
    """How often what came lies at or under the forecast, and the mean pinball loss, of ``told(alpha, actual, predicted)``."""
    miss = F.col("actual") - F.col("predicted")
    loss = F.greatest(F.col("alpha") * miss, (F.col("alpha") - 1) * miss)
    return told.groupBy("alpha").agg(F.count("*").alias("n"), F.avg((miss <= 0).cast("double")).alias("coverage"), F.avg(loss).alias("pinball"))


def quantile_backtest(panel: DataFrame, alphas: list[float], held: int, rounds: int = 12) -> DataFrame:
    """``(alpha, serie, cycle, actual, predicted)`` of the last ``held`` cycles, learnt from those before them."""
    rows = training_rows(panel).checkpoint()
    last = rows.agg(F.max("idx")).first()[0] or 0
    train, test = rows.where(F.col("idx") <= last - held), rows.where(F.col("idx") > last - held)
    found = [fit_quantile(train, a, rounds).predict(test).select(F.lit(float(a)).alias("alpha"), "serie", "cycle", "actual", "predicted") for a in alphas]
    return reduce(DataFrame.unionByName, found)


def newest(panel: DataFrame, cycles: int) -> tuple[DataFrame, DataFrame]:
    """The panel without its last ``cycles``, and those."""
    index = folds.cycle_index(panel).select("cycle", F.dense_rank().over(Window.orderBy(F.desc("idx"))).alias("_back"))
    rows = panel.join(F.broadcast(index), "cycle")
    return rows.where(F.col("_back") > cycles).drop("_back"), rows.where(F.col("_back") <= cycles).drop("_back")
