"""Paths over several future cycles, ablations, and sizes in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average_path(panel: DataFrame, window: int, steps: int) -> DataFrame:
    """``(serie, step, predicted)``: each step's mean of the last ``window`` values is the next one's history.

    A series' state is an array of ``window`` values, so all steps are one fold: no job per step and
    no lineage that grows.
    """
    recent = panel.withColumn("_r", F.row_number().over(Window.partitionBy("serie").orderBy(F.desc("opening_date")))).where(F.col("_r") <= window)
    held = recent.groupBy("serie").agg(F.transform(F.array_sort(F.collect_list(F.struct("opening_date", F.col("items").cast("double").alias("x")))), lambda s: s["x"]).alias("h"))

    def mean(values: Column) -> Column:
        last = F.slice(values, F.greatest(F.size(values) - window + 1, F.lit(1)), F.lit(window))
        return F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("h"), lambda state, _: F.concat(state, F.array(mean(state))))
    path = held.select("serie", F.posexplode(F.slice(walked, F.size("h") + 1, F.lit(steps))).alias("_at", "predicted"))
    return path.select("serie", (F.col("_at") + 1).alias("step"), "predicted")


def leave_one_out(panel: DataFrame, lags: dict[str, int]) -> DataFrame:
    """``(variant, mae, effect)``: the mean of all lags, and without each of them, on common points."""
    spec = Window.partitionBy("serie").orderBy("opening_date")
    rows = panel.select(F.col("items").cast("double").alias("actual"), *(F.lag("items", n).over(spec).cast("double").alias(name) for name, n in lags.items())).dropna(subset=list(lags))

    def mean(names: list[str]) -> Column:
        return sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.lit(float(len(names)))

    variants = {"full": list(lags)} | {f"without {name}": [n for n in lags if n != name] for name in lags}
    errors = F.array(*(F.struct(F.lit(v).alias("variant"), F.abs(F.col("actual") - mean(names)).alias("e")) for v, names in variants.items()))
    scored = rows.select(F.explode(errors).alias("v")).groupBy("v.variant").agg(F.avg("v.e").alias("mae"))
    full = F.max(F.when(F.col("variant") == "full", F.col("mae"))).over(Window.partitionBy())
    return scored.withColumn("effect", F.col("mae") - full)


def model_size(sectors: DataFrame, lengths: DataFrame, slots: int, cds: int) -> DataFrame:
    """Variables and constraints of the exact assignment model: ``sectors(sectors)``, ``lengths(d)`` of its cycles."""
    days = lengths.agg(F.sum("d").alias("days"), F.count("*").alias("cycles"))
    both = sectors.crossJoin(F.broadcast(days))
    s, d = F.col("sectors"), F.col("days")
    return both.select((s * slots).alias("binary_variables"), (F.col("cycles") * 2).alias("continuous_variables"), (s + 2 * d + F.least(s, F.lit(cds).cast("long")) * d + 1).alias("constraints"))


def certified_gap(rows: DataFrame, objective: str = "objective", bound: str = "lower_bound") -> DataFrame:
    """``vs_incumbent`` = (objective - bound) / objective and ``vs_optimum`` = (objective - bound) / bound, null without a positive bound."""
    o, b = F.col(objective), F.col(bound)
    return rows.withColumns({"vs_incumbent": F.try_divide(o - b, o), "vs_optimum": F.when(b > 0, (o - b) / b)})


def best_of_k(runs: DataFrame, ks: list[int], draws: int = 1000, seed: int = 0) -> DataFrame:
    """``(k, mean_improvement_pct)`` of keeping the run that ``runs(forecast_to_be, realized_improvement_pct)``
    forecasts lowest among k drawn without replacement, over ``draws`` draws.

    A draw orders all runs by a seeded hash and takes the first k. Runs are few by nature: one per seed.
    """
    numbered = runs.select("forecast_to_be", "realized_improvement_pct", F.row_number().over(Window.orderBy("forecast_to_be", "realized_improvement_pct")).alias("run"))
    drawn = numbered.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    place = F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "run"), "run"))
    placed = drawn.withColumn("place", place)
    count = F.count("*").over(Window.partitionBy("draw"))
    asked = placed.withColumn("n", count).withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("place <= k and k <= n")
    picked = asked.groupBy("draw", "k").agg(F.min_by("realized_improvement_pct", F.struct("forecast_to_be", "run")).alias("x"))
    return picked.groupBy("k").agg(F.avg("x").alias("mean_improvement_pct"))
