"""Rolling-origin back-tests, all origins in one plan.

An origin is a cycle whose items are forecast from the cycles before it. Forecasts that only need
running statistics come from window frames; the others from per-origin arrays or aggregates joined by
a small (origin, cycle) bridge, so no fold is a job of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators.features import before, of_series

#: Cycles before the first origin; all later ones are origins unless ``max_origins`` says otherwise.
MIN_TRAIN = 20


def cycle_index(panel: DataFrame) -> DataFrame:
    """``(cycle, opening_date, idx)``: cycles in the order of their openings, from 1."""
    found = panel.groupBy("cycle").agg(F.min("opening_date").alias("opening_date"))
    return found.withColumn("idx", F.row_number().over(Window.orderBy("opening_date", "cycle")))


def origins(panel: DataFrame, min_train: int = MIN_TRAIN, max_origins: int | None = None) -> DataFrame:
    """``(cycle, origin)``: the cycles that have at least ``min_train`` before them, or the last of these."""
    index = cycle_index(panel)
    found = index.where(F.col("idx") > min_train).select("cycle", F.col("idx").alias("origin"))
    return found.orderBy(F.desc("origin")).limit(max_origins) if max_origins else found


def bridge(panel: DataFrame, window: int | None = None, min_train: int = MIN_TRAIN, max_origins: int | None = None) -> DataFrame:
    """``(origin, cycle)`` of the training cycles: all before, or the last ``window`` of them."""
    targets = origins(panel, min_train, max_origins).select("origin")
    pairs = cycle_index(panel).crossJoin(F.broadcast(targets)).where("idx < origin")
    return (pairs.where(F.col("idx") >= F.col("origin") - window) if window else pairs).select("origin", "cycle")


def floored(prediction: Column) -> Column:
    """At least 0; a missing forecast stays missing."""
    return F.when(prediction > 0, prediction).when(prediction.isNotNull(), 0.0)


def scored(panel: DataFrame, candidate: str, prediction: Column, **options: int) -> DataFrame:
    """Points of a candidate whose prediction is a column over the series' window; nulls are skipped."""
    rows = panel.select("serie", "cycle", "opening_date", "window_start", "cycle_days", F.col("items").cast("double").alias("actual"), floored(prediction).alias("predicted"))
    rows = rows.join(F.broadcast(origins(panel, **options)), "cycle").where("predicted is not null")
    return rows.select(F.lit(candidate).alias("candidate"), "serie", "cycle", "origin", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))


def last_value() -> Column:
    return F.lag("items", 1).over(of_series()).cast("double")


def mean() -> Column:
    return F.avg("items").over(before(of_series()))


def seasonal(length: int) -> Column:
    """The value ``length`` rows before; none in shorter series."""
    return F.lag("items", length).over(of_series()).cast("double")


def moving_average(window: int) -> Column:
    return F.avg("items").over(before(of_series(), window))


def recursive(panel: DataFrame, candidate: str, start: Column, step, forecast, **options: int) -> DataFrame:
    """Points of a candidate whose state goes on from one cycle to the next.

    Each series is one array, folded once: ``step(state, x)`` takes a cycle in and ``forecast(state)`` is
    told before that, so all origins come out of one pass.
    """
    arrays = panel.groupBy("serie").agg(F.array_sort(F.collect_list(F.struct("opening_date", "cycle", F.col("items").cast("double").alias("x")))).alias("s"))
    first = F.struct(start.alias("state"), F.array().cast("array<double>").alias("out"))
    told = F.aggregate("s", first, lambda a, v: F.struct(step(a["state"], v["x"]).alias("state"), F.concat(a["out"], F.array(forecast(a["state"]))).alias("out")), lambda a: a["out"])
    rows = arrays.select("serie", F.explode(F.arrays_zip("s", told.alias("p"))).alias("r")).select("serie", "r.s.cycle", F.col("r.s.x").alias("actual"), floored(F.col("r.p")).alias("predicted"))
    rows = rows.join(F.broadcast(origins(panel, **options)), "cycle").where("predicted is not null")
    return rows.select(F.lit(candidate).alias("candidate"), "serie", "cycle", "origin", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))


def ses_backtest(panel: DataFrame, alpha: float) -> DataFrame:
    """Simple exponential smoothing from the first observation."""
    step = lambda level, x: F.coalesce(level + alpha * (x - level), x)
    return recursive(panel, f"ets:{alpha}", F.lit(None).cast("double"), step, lambda level: level)


def croston_backtest(panel: DataFrame, variant: str = "sba", alpha: float = 0.1, beta: float = 0.1, least: int = 3) -> DataFrame:
    """Croston's size and interval, its bias-corrected form ``sba``, or ``tsb`` with a demand probability.

    No demand at all gives 0; under ``least`` cycles, nothing.
    """
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("size"), none.alias("gap"), F.lit(0.0).alias("since"), none.alias("prob"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        first, bought = s["size"].isNull(), x > 0
        since = s["since"] + 1.0
        size = F.when(first & bought, x).when(bought, s["size"] + alpha * (x - s["size"])).otherwise(s["size"])
        gap = F.when(first & bought, since).when(bought, s["gap"] + alpha * (since - s["gap"])).otherwise(s["gap"])
        prob = F.when(first & bought, 1.0 / since).when(first, none).otherwise(s["prob"] + beta * (bought.cast("double") - s["prob"]))
        return F.struct(size.alias("size"), gap.alias("gap"), F.when(bought, 0.0).otherwise(since).alias("since"), prob.alias("prob"), (s["n"] + 1).alias("n"))

    def forecast(s: Column) -> Column:
        classic = F.try_divide(s["size"], s["gap"])
        value = {"classic": classic, "sba": (1 - alpha / 2) * classic, "tsb": s["prob"] * s["size"]}[variant]
        return F.when(s["n"] >= least, F.coalesce(value, F.lit(0.0)))

    return recursive(panel, f"croston:{variant}", start, step, forecast)


def cycle_factors(panel: DataFrame) -> DataFrame:
    """Per cycle: items over what the series' running means expected, a ratio of sums."""
    rows = panel.select("opening_date", "items", mean().alias("expected")).where("expected > 0")
    return rows.groupBy("opening_date").agg((F.sum("items") / F.sum("expected")).alias("factor"))


def cycle_factor_backtest(panel: DataFrame, strategy: str = "last", window: int = 1) -> DataFrame:
    """Series mean times the factor of the last cycle, the mean of the last ``window``, or of all."""
    spec = Window.orderBy("opening_date")
    frame = {"last": spec.rowsBetween(-1, -1), "mean": spec.rowsBetween(-window, -1), "all": spec.rowsBetween(Window.unboundedPreceding, -1)}[strategy]
    days = panel.select("opening_date").distinct().join(cycle_factors(panel), "opening_date", "left")
    seen = days.withColumn("used", F.avg("factor").over(frame)) if strategy != "last" else days.withColumn("used", F.last("factor", True).over(spec.rowsBetween(Window.unboundedPreceding, -1)))
    joined = panel.withColumn("_mean", mean()).join(F.broadcast(seen.select("opening_date", F.coalesce("used", F.lit(1.0)).alias("_factor"))), "opening_date")
    name = f"cycle_factor:{strategy}" + ("" if strategy == "all" else str(window))
    return scored(joined, name, F.col("_mean") * F.col("_factor"))


def training(panel: DataFrame, **options: int) -> DataFrame:
    """Panel rows once per origin that they train: an equi-join with the broadcast bridge."""
    return panel.join(F.broadcast(bridge(panel, **options)), "cycle")


def days_exponent(rows: DataFrame, by: list[str]) -> DataFrame:
    """How items scale with window length, by ``by``: the slope of log items on log days within series.

    Between 0 and 1; 0 where no length varied. Sums of products only, no demeaning pass.
    """
    usable = rows.where("items > 0 and cycle_days > 0").select(*by, "serie", F.log(F.col("cycle_days").cast("double")).alias("x"), F.log(F.col("items").cast("double")).alias("y"))
    each = usable.groupBy(*by, "serie").agg(
        (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count("*")).alias("sxx"),
        (F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y") / F.count("*")).alias("sxy"),
    )
    slope = F.when(F.sum("sxx") > 1e-9, F.sum("sxy") / F.sum("sxx")).otherwise(0.0)
    return each.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), slope)).alias("exponent"))


def window_scaled_mean(panel: DataFrame) -> DataFrame:
    """Mean of items per unit of window length (days to the fold's exponent), times the target's own."""
    train = training(panel)
    exponents = days_exponent(train, ["origin"]).withColumn("exponent", F.round("exponent", 6))
    levels = train.join(F.broadcast(exponents), "origin").groupBy("origin", "serie").agg(
        F.avg(F.col("items") / F.pow(F.col("cycle_days").cast("double"), F.col("exponent"))).alias("level"), F.first("exponent").alias("exponent")
    )
    targets = panel.join(F.broadcast(origins(panel)), "cycle").join(levels, ["origin", "serie"])
    predicted = F.col("level") * F.pow(F.col("cycle_days").cast("double"), F.col("exponent"))
    return targets.select(F.lit("naive:mean scaled").alias("candidate"), "serie", "cycle", "origin", F.col("items").cast("double").alias("actual"), predicted.alias("predicted"), F.abs(F.col("items") - predicted).alias("abs_error"))


def opening_factors(panel: DataFrame, passes: int = 10, prior: float = 100.0) -> DataFrame:
    """``(opening_day, factor)``: effect on items of opening so many days into the cycle.

    Log items relative to their series and their cycle, by alternating passes, then the mean by day
    shrunk towards 0. A series is one array; a pass changes one number a series and one a cycle, and only
    the cycles' (17 a year) leave the tasks.
    """
    rows = panel.where("items > 0").select("serie", F.struct("cycle", F.datediff("window_start", "opening_date").alias("day"), F.log(F.col("items").cast("double")).alias("y")).alias("v"))
    arrays = rows.groupBy("serie").agg(F.collect_list("v").alias("s")).withColumn("level", F.lit(0.0)).checkpoint()
    effects: dict[str, float] = {r.cycle: 0.0 for r in arrays.select(F.explode("s.cycle").alias("cycle")).distinct().collect()}

    def residuals(arrays: DataFrame) -> DataFrame:
        known = F.create_map(*(F.lit(x) for pair in effects.items() for x in pair)) if effects else F.create_map().cast("map<string,double>")
        return arrays.withColumn("r", F.transform("s", lambda v: v["y"] - F.col("level") - F.element_at(known, v["cycle"])))

    for _ in range(passes):
        own = residuals(arrays)
        mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r")
        arrays = own.withColumn("level", F.col("level") + mean).drop("r").checkpoint()
        moved = residuals(arrays).select(F.explode(F.arrays_zip("s", "r")).alias("z")).groupBy(F.col("z.s.cycle").alias("cycle")).agg(F.avg("z.r").alias("e"))
        effects |= {r.cycle: effects[r.cycle] + r.e for r in moved.collect()}
    last = residuals(arrays).select(F.explode(F.arrays_zip("s", "r")).alias("z"))
    return last.groupBy(F.col("z.s.day").alias("opening_day")).agg(F.exp(F.sum("z.r") / (F.count("*") + prior)).alias("factor"))


def pooled_ets(rows: DataFrame, alphas: list[float], exponents: list[float]) -> DataFrame:
    """In-sample one-step absolute error of each (alpha, exponent), over all series.

    Each series is an array folded once per setting; settings are crossed in as a small literal array.
    """
    arrays = rows.groupBy("serie").agg(F.array_sort(F.collect_list(F.struct("opening_date", F.col("items").cast("double").alias("x"), F.col("cycle_days").cast("double").alias("d")))).alias("s"))
    settings = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(e)).alias("exponent")) for a in alphas for e in exponents))
    each = arrays.select("serie", "s", F.explode(settings).alias("g")).select("serie", "s", "g.alpha", "g.exponent")
    start = F.struct(F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("error"))

    def step(state: Column, v: Column) -> Column:
        scale = F.pow(v["d"], F.col("exponent"))
        x, fresh = v["x"] / scale, state["level"].isNull()
        error = F.when(fresh, state["error"]).otherwise(state["error"] + F.abs(x - state["level"]) * scale)
        return F.struct(F.when(fresh, x).otherwise(state["level"] + F.col("alpha") * (x - state["level"])).alias("level"), error.alias("error"))

    folded = each.select("serie", "alpha", "exponent", F.aggregate("s", start, step).alias("f"))
    return folded.select("serie", "alpha", "exponent", F.col("f.level").alias("level"), F.col("f.error").alias("error"))


def pooled_ets_choice(folded: DataFrame) -> DataFrame:
    sums = folded.groupBy("alpha", "exponent").agg(F.sum("error").alias("error"))
    return sums.agg(F.min_by(F.struct("alpha", "exponent", "error"), F.struct(F.round("error", 6), "alpha", "exponent")).alias("b")).select("b.*")
