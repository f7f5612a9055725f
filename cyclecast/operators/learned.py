"""Pooled learners on the panel's features, with Spark ML."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import features, folds

INPUTS = ["items_lag_1", "items_lag_2", "items_lag_3", "items_lag_4", "items_mean_3", "items_mean_6", "level_ref", "orders_lag_1", "volumes_lag_1", "items_per_order_lag_1", "days_since_previous", "cycle_number", "cycle_days"]


def _matrix(panel: DataFrame) -> DataFrame:
    """Features as doubles; a missing one is imputed and flagged."""
    rows = features.build(panel).select("serie", "cycle", F.col("items").cast("double").alias("actual"), *(F.col(c).cast("double").alias(c) for c in INPUTS))
    return rows.select("*", *(F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in INPUTS))


def backtest(panel: DataFrame, kind: str = "gbt", origins: int = 3) -> DataFrame:
    """Points of the last ``origins`` cycles, each learnt from the cycles before it.

    ``gbt``: boosted trees on absolute error, target relative to the series' mean so far; ``tweedie``:
    a log-linear model with variance power 1.3. Predictions are at least 0. A fit is a job of its own, so
    origins are few by default.
    """
    rows = _matrix(panel).where("level_ref > 0").join(F.broadcast(folds.cycle_index(panel).select("cycle", F.col("idx").alias("origin"))), "cycle").checkpoint()
    targets = [r.origin for r in folds.origins(panel, max_origins=origins).collect()]
    found = None
    for origin in sorted(targets):
        own = _predicted(rows.where(F.col("origin") < origin), rows.where(F.col("origin") == origin), kind)
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise ValueError("no cycle has enough before it")
    return found


def _predicted(train: DataFrame, test: DataFrame, kind: str) -> DataFrame:
    names = INPUTS + [f"{c}_missing" for c in INPUTS]
    filler = Imputer(inputCols=INPUTS, outputCols=INPUTS, strategy="median").fit(train)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    if kind == "gbt":
        learner = GBTRegressor(labelCol="label", lossType="absolute", maxIter=20, maxDepth=4, stepSize=0.1, seed=0)
        label, value = F.col("actual") / F.col("level_ref"), F.col("prediction") * F.col("level_ref")
    else:
        learner = GeneralizedLinearRegression(labelCol="label", family="tweedie", variancePower=1.3, linkPower=0.0, maxIter=15, regParam=0.1)
        label, value = F.col("actual"), F.col("prediction")
    model = learner.fit(assembler.transform(filler.transform(train)).withColumn("label", label))
    found = model.transform(assembler.transform(filler.transform(test))).withColumn("predicted", F.greatest(value, F.lit(0.0)))
    return found.select(F.lit(kind).alias("candidate"), "serie", "cycle", "origin", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))
