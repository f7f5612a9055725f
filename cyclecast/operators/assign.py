"""Assignments of sectors to slots: demand under every slot, evaluation, and annealing over many seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, SPAN = 15, 21
#: Numbers of an instance that annealing may hold in a task (200 MB).
MAX_CELLS = 25_000_000


def sector_curves(days: DataFrame, cycles: DataFrame) -> DataFrame:
    """Items by sector, place of the cycle in ``cycles(cycle, at)`` and day of the window."""
    rows = days.join(F.broadcast(cycles), "cycle")
    return rows.groupBy("sector", "at", "offset").agg(F.sum("actual").alias("items")).where("items > 0")


def projected_demand(curves: DataFrame, span: int = SPAN, slots: int = SLOTS) -> DataFrame:
    """``(sector, day, slot, qty)``: where each curve lands if its window opens on each slot's day."""
    spread = curves.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots))))
    return spread.groupBy("sector", (F.col("at") * span + F.col("slot") + F.col("offset")).alias("day"), "slot").agg(F.sum("items").alias("qty"))


def balance_days(demand: DataFrame, span: int = SPAN, ramp: int = SLOTS - 1) -> DataFrame:
    """``(day, cycle_no)`` without the first and last ``ramp`` days, when not all slots can be open."""
    days = demand.select("day").distinct()
    ends = days.agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    inner = days.crossJoin(F.broadcast(ends)).where(F.col("day").between(F.col("_a") + ramp, F.col("_b") - ramp))
    return inner.select("day", F.floor((F.col("day") - 1) / span).cast("int").alias("cycle_no"))


def daily_capacity(demand: DataFrame, cd_shares: DataFrame, headroom: float = 1.1) -> DataFrame:
    """``(cd, capacity)``: flat, the CD's mean daily load over all slots with some headroom."""
    days = demand.agg(F.count_distinct("day").alias("_d"))
    mean = demand.groupBy("sector").agg((F.sum("qty") / F.count_distinct("slot")).alias("_q"))
    loads = mean.join(cd_shares, "sector").groupBy("cd").agg(F.sum(F.col("_q") * F.col("cd_share")).alias("_l"))
    return loads.crossJoin(F.broadcast(days)).select("cd", (headroom * F.col("_l") / F.col("_d")).alias("capacity"))


def infer_as_is(base: DataFrame, cycle: str | DataFrame, slots: int = SLOTS, quantile: float = 0.05) -> DataFrame:
    """Each sector's slot: its opening in ``cycle`` (a name, or a row with it) from a robust start of the cycle.

    The start is the ``quantile`` of the sectors' openings, the lower of two; slots are cut to 1 to
    ``slots``. Sectors without the cycle take the median slot. Openings are counted by date, so nothing
    but a cycle's dates meets in one task.
    """
    last = base.sparkSession.createDataFrame([(cycle,)], "cycle string") if isinstance(cycle, str) else cycle
    openings = base.join(F.broadcast(last), "cycle", "left_semi").groupBy("sector").agg(F.min("opening_date").alias("opening"))
    by_date = openings.groupBy("opening").agg(F.count("*").alias("n"))
    run = Window.orderBy("opening").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    start = by_date.select("opening", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("all")).where(F.col("upto") > F.floor(quantile * (F.col("all") - 1))).agg(F.min("opening").alias("_start"))
    placed = openings.crossJoin(F.broadcast(start)).select("sector", F.greatest(F.lit(1), F.least(F.lit(slots), F.datediff("opening", "_start") + 1)).alias("slot"))
    median = placed.agg(F.floor(F.percentile("slot", F.lit(0.5))).cast("int").alias("_median"))
    every = base.select("sector").distinct().join(placed, "sector", "left").crossJoin(F.broadcast(median))
    return every.select("sector", F.coalesce("slot", "_median").alias("slot"))


def evaluate(demand: DataFrame, assignments: DataFrame, cd_shares: DataFrame, capacity: DataFrame, as_is: DataFrame, days: DataFrame) -> DataFrame:
    """Per assignment_id of ``assignments(assignment_id, sector, slot)``: balance, excess, churn.

    Balance is the mean over cycles of the daily totals' range, excess what CDs' daily loads go over
    capacity, churn 2 per moved sector (1 without an As-Is). Any number of assignments is one job.
    """
    placed = assignments.join(demand, ["sector", "slot"])
    totals = placed.groupBy("assignment_id", "day").agg(F.sum("qty").alias("qty"))
    grid = assignments.select("assignment_id").distinct().crossJoin(F.broadcast(days))
    ranges = grid.join(totals, ["assignment_id", "day"], "left").fillna(0.0, ["qty"]).groupBy("assignment_id", "cycle_no").agg((F.max("qty") - F.min("qty")).alias("r"))
    balance = ranges.groupBy("assignment_id").agg(F.avg("r").alias("objective"))
    loads = placed.join(cd_shares, "sector").groupBy("assignment_id", "cd", "day").agg(F.sum(F.col("qty") * F.col("cd_share")).alias("load"))
    loads = loads.join(capacity, "cd")
    excess = loads.groupBy("assignment_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("load") - F.col("capacity"))).alias("capacity_violation"), F.max(F.col("load") / F.nullif("capacity", F.lit(0.0))).alias("utilization"))
    moved = assignments.join(as_is.select("sector", F.col("slot").alias("_s")), "sector", "left")
    used = moved.groupBy("assignment_id").agg(F.sum(F.when(F.col("_s").isNull(), 1).when(F.col("_s") == F.col("slot"), 0).otherwise(2)).alias("churn"))
    return balance.join(excess, "assignment_id").join(used, "assignment_id")


def explain(evaluated: DataFrame, before: str, after: str) -> DataFrame:
    """``(metric, before, after, change_pct)`` of two assignments."""
    long = evaluated.select("assignment_id", F.expr("stack(4, 'objective', objective, 'capacity_violation', capacity_violation, 'utilization', utilization, 'churn', cast(churn as double)) as (metric, value)"))
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("assignment_id") == before, F.col("value"))).alias("before"), F.max(F.when(F.col("assignment_id") == after, F.col("value"))).alias("after"))
    return wide.withColumn("change_pct", 100 * (F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0)))


def anneal(spark: SparkSession, demand: DataFrame, as_is: DataFrame, days: DataFrame, runs: DataFrame, iterations: int = 3000) -> DataFrame:
    """``(run, seed, start, objective, iterations, slots)``: simulated annealing, a task per run.

    ``runs(run, seed, temperature, cooling)``. The instance, sectors x slots x days, goes to the tasks as
    one array; it is measured before anything is collected and may have ``MAX_CELLS`` at most.
    """
    size = demand.agg(F.count_distinct("sector").alias("s"), F.max("day").alias("d")).first()
    if size.s * (SLOTS + 1) * ((size.d or 0) + 1) > MAX_CELLS:
        raise ValueError(f"{size.s} sectors by {size.d} days are too many to anneal in a task")
    rows, order = demand.toPandas(), as_is.toPandas()
    sectors = sorted(rows["sector"].unique())
    inside = days.toPandas()
    width = int(rows["day"].max()) + 1
    tensor = np.zeros((len(sectors), SLOTS + 1, width))
    tensor[rows["sector"].map({s: i for i, s in enumerate(sectors)}), rows["slot"], rows["day"]] = rows["qty"]
    known = dict(zip(order["sector"], order["slot"]))
    start = np.array([known.get(s, 1) for s in sectors])
    groups = [g["day"].to_numpy() for _, g in inside.groupby("cycle_no")]
    shared = spark.sparkContext.broadcast((tensor, start, groups))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tensor, start, groups = shared.value

        def balance(total: np.ndarray) -> float:
            return float(np.mean([np.ptp(total[g]) for g in groups]))

        for frame in frames:
            for run in frame.itertuples():
                rng, now = np.random.default_rng(run.seed), start.copy()
                total = tensor[np.arange(len(now)), now].sum(0)
                energy = first = balance(total)
                best, kept, heat = energy, now.copy(), run.temperature
                for _ in range(iterations):
                    s, to = rng.integers(len(now)), rng.integers(1, SLOTS + 1)
                    moved = total - tensor[s, now[s]] + tensor[s, to]
                    value = balance(moved)
                    if value <= energy or rng.random() < np.exp((energy - value) / max(heat, 1e-9)):
                        now[s], total, energy = to, moved, value
                        if energy < best:
                            best, kept = energy, now.copy()
                    heat *= run.cooling
                yield pd.DataFrame({"run": [run.run], "seed": [run.seed], "start": [first], "objective": [best], "iterations": [iterations], "slots": [kept.tolist()]})

    return runs.mapInPandas(solve, "run long, seed long, start double, objective double, iterations long, slots array<long>")


def largest_sectors(curves: DataFrame, count: int) -> DataFrame:
    """The rows of the ``count`` sectors with the most items; of equal ones the first by name."""
    top = curves.groupBy("sector").agg(F.sum("items").alias("_t")).orderBy(F.desc("_t"), "sector").limit(count).select("sector")
    return curves.join(F.broadcast(top), "sector", "left_semi")


def assignment_table(assignments: DataFrame, as_is: DataFrame, main_cd: DataFrame, per_block: int = 5) -> DataFrame:
    """Each sector's slot as block and sub-block beside its As-Is one, with its main CD and whether it moved."""
    block = lambda slot: (F.floor((F.col(slot) - 1) / per_block) + 1).cast("int")
    rows = assignments.join(as_is.select("sector", F.col("slot").alias("as_is_slot")), "sector", "left").join(main_cd, "sector", "left")
    return rows.select(
        "assignment_id", "sector", "cd", "slot", block("slot").alias("block"), ((F.col("slot") - 1) % per_block + 1).alias("sub_block"), "as_is_slot",
        F.coalesce(F.col("slot") != F.col("as_is_slot"), F.lit(True)).alias("moved"),
    )


def rescore(evaluated: DataFrame, realized: DataFrame) -> DataFrame:
    """Assignments' objectives on forecast demand beside those on what came, each against As-Is (0)."""
    value = lambda df, name: df.select("assignment_id", F.col("objective").alias(name))
    both = value(evaluated, "forecast").join(value(realized, "realized"), "assignment_id")
    base = F.broadcast(both.where("assignment_id = 0").select(F.col("forecast").alias("_f"), F.col("realized").alias("_r")))
    gain = lambda name, of: 100 * (F.col(of) - F.col(name)) / F.nullif(of, F.lit(0.0))
    return both.crossJoin(base).select("assignment_id", "forecast", "realized", gain("forecast", "_f").alias("forecast_gain_pct"), gain("realized", "_r").alias("realized_gain_pct"))
