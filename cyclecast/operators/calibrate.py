"""Analysis of solver runs ``(config, instance, seed, param, objective, feasible)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INFEASIBLE_GAP = 100.0


def with_gaps(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Per cent over the instance's reference; 100 if infeasible, null without a reference."""
    gap = F.when(~F.col("feasible"), INFEASIBLE_GAP).otherwise(100 * (F.col("objective") - F.col("reference")) / F.nullif("reference", F.lit(0.0)))
    return runs.join(F.broadcast(references), "instance", "left").withColumn("gap", F.when(F.col("reference").isNotNull(), gap))


def summarize(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"), F.percentile("gap", F.lit(0.9)).alias("p90"), F.avg(F.col("feasible").cast("double")).alias("feasible_rate"))


def main_effects(runs: DataFrame, param: str, bins: int = 4) -> DataFrame:
    """Mean and deviation of the gap by quantile bin of a parameter.

    Bins are right-closed, the first has the lowest value, too, and equal edges are one: an inner edge
    that equals the minimum makes no bin.
    """
    edges = runs.agg(F.percentile(param, F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("_e")).select(F.array_distinct("_e").alias("_e"))
    rows = runs.where(F.col(param).isNotNull()).crossJoin(F.broadcast(edges))  # a row of its own
    at = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: F.col(param) > e)))
    binned = rows.withColumn("bin", at.cast("long")).withColumns({"left": F.get("_e", F.col("bin").cast("int") - 1), "right": F.get("_e", F.col("bin").cast("int"))})
    return binned.groupBy("bin", "left", "right").agg(F.avg("gap").alias("gap_mean"), F.stddev_samp("gap").alias("gap_std"), F.count("gap").alias("n_runs"))


def rank_by_rule(summary: DataFrame, tolerance: float) -> DataFrame:
    """``place`` of each row of ``summary(config, gap_mean, gap_p90, complexity)``, without a mean none.

    The best is picked again and again: within ``tolerance`` of the remaining rows' least gap, then of
    the least p90 among those, the simplest, then that of the least gap. A table of configurations is
    one array, folded once.
    """
    row = F.struct("complexity", "gap_mean", "config", "gap_p90")
    all_ = summary.where("gap_mean is not null").agg(F.collect_list(row).alias("rest")).where(F.size("rest") > 0)
    shape = dict(all_.dtypes)["rest"]

    def pick(state: Column, _: Column) -> Column:
        rest = state["rest"]
        tied = F.filter(rest, lambda x: x["gap_mean"] <= F.array_min(F.transform(rest, lambda y: y["gap_mean"])) + tolerance)
        close = F.filter(tied, lambda x: x["gap_p90"] <= F.array_min(F.transform(tied, lambda y: y["gap_p90"])) + tolerance)
        best = F.array_min(close)
        return F.struct(F.filter(rest, lambda x: x["config"] != best["config"]).alias("rest"), F.concat(state["done"], F.array(best)).alias("done"))

    start = F.struct(F.col("rest"), F.array().cast(shape).alias("done"))
    done = F.aggregate(F.sequence(F.lit(1), F.size("rest")), start, pick, lambda s: s["done"])
    return all_.select(F.posexplode(done).alias("place", "r")).select("r.config", "r.gap_mean", "r.gap_p90", "r.complexity", (F.col("place") + 1).alias("place"))


def always_feasible(runs: DataFrame) -> DataFrame:
    return runs.groupBy("config").agg(F.bool_and("feasible").alias("_all")).where("_all").select("config")


def ranks(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Ranks within ``by``; ties share their mean rank."""
    order, same = Window.partitionBy(by).orderBy(value), Window.partitionBy(by, value)
    return rows.withColumn(name, F.rank().over(order) + (F.count("*").over(same) - 1) / 2)


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Rank correlation within ``by``, and what picking by ``a`` gets of ``b``: picked, mean, best."""
    ranked = ranks(ranks(rows, by, a, "_ra"), by, b, "_rb")
    return ranked.groupBy(by).agg(F.corr("_ra", "_rb").alias("rho"), F.min_by(b, F.struct(a, b)).alias("picked"), F.avg(b).alias("mean"), F.min(b).alias("oracle"))


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    mean, std = F.avg(value), F.stddev_samp(value)
    return rows.groupBy(by).agg(mean.alias("mean"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), (std / F.nullif(mean, F.lit(0.0))).alias("cv"))


def add_gaps(table: DataFrame, by: str, value: str) -> DataFrame:
    """Per cent that each row's value lies over the least one of its group."""
    least = F.min(value).over(Window.partitionBy(by))
    return table.withColumn("gap_pct", 100 * (F.col(value) - least) / F.nullif(least.cast("double"), F.lit(0.0)))


def best_bounds(records: DataFrame) -> DataFrame:
    """Per instance of ``records(instance, solver, objective, bound)``: the least objective and the greatest bound."""
    return records.groupBy("instance").agg(F.min("objective").alias("upper"), F.max("bound").alias("lower"))


def proven_optima(records: DataFrame, tolerance: float) -> DataFrame:
    """Instances whose runs closed their gap, with the value they agree on; ``agree`` is false if they don't."""
    closed = records.where(F.col("objective") - F.col("bound") <= tolerance * F.greatest(F.abs("objective"), F.lit(1.0)))
    found = closed.groupBy("instance").agg(F.min("objective").alias("optimum"), F.max("objective").alias("_most"), F.count("*").alias("proofs"))
    return found.select("instance", "optimum", "proofs", (F.col("_most") - F.col("optimum") <= tolerance * F.greatest(F.abs("optimum"), F.lit(1.0))).alias("agree"))


def seed_spread(runs: DataFrame, value: str) -> DataFrame:
    """Mean and deviation over the runs of each scenario and window, of each scenario, and of all."""
    return runs.rollup("scenario", "window").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def latin_hypercube(spark: SparkSession, points: int, dims: dict[str, tuple[float, float, bool]], seed: int = 0) -> DataFrame:
    """``(point, one column a dimension)``: in each dimension every one of ``points`` equal strata holds one point.

    ``dims``: the least and greatest value, and whether the strata are equal in the logarithm. Strata are
    dealt out by seeded hashes, and places within them drawn by others, so a row is the same in any run.
    """
    if points < 1 or any(low >= high or log and low <= 0 for low, high, log in dims.values()):
        raise ValueError("a dimension goes from a lower to a higher value, above 0 where it is logarithmic")
    rows = spark.range(1, points + 1).withColumnRenamed("id", "point")
    for at, (name, (low, high, log)) in enumerate(dims.items()):
        draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(at), F.lit(salt), "point")  # noqa: B023, E731
        within = F.pmod(draw(1), F.lit(1 << 20)) / float(1 << 20)
        share = (F.row_number().over(Window.orderBy(draw(0), "point")) - 1 + within) / points  # as many rows as points are asked for
        rows = rows.withColumn(name, F.lit(low) * F.pow(F.lit(high / low), share) if log else F.lit(low) + (high - low) * share)
    return rows
