"""Exponential smoothing with trend, damping and season, its weights searched per series.

A series is one array, folded once per setting of the weights, and tells a forecast and its fit so far
before each cycle. So each origin has the setting that fits the cycles before it best, and all origins of
all series come out of one aggregation, in which nothing but the series moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclecast.operators.folds import floored, origins


@dataclass(frozen=True)
class Form:
    """Which components a model has, and the weights that are tried.

    ``error``: ``add`` fits by squared errors, ``mul`` by the likelihood of errors in proportion to the
    forecast. ``trend``: None or ``add``, damped by ``dampings`` where ``damped``. ``season``: None, ``add``
    or ``mul``, of ``period`` cycles.
    """

    error: str = "add"
    trend: str | None = None
    damped: bool = False
    season: str | None = None
    period: int = 0
    alphas: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)
    betas: tuple[float, ...] = (0.05, 0.1, 0.3)
    dampings: tuple[float, ...] = (0.8, 0.9, 0.98)
    gammas: tuple[float, ...] = (0.05, 0.1, 0.3)
    settings: tuple[tuple[float, float, float, float], ...] = field(init=False)

    def __post_init__(self) -> None:
        if self.error not in ("add", "mul") or self.trend not in (None, "add") or self.season not in (None, "add", "mul"):
            raise ValueError("error is add or mul, trend add or None, season add, mul or None")
        if self.damped and not self.trend or (self.season is None) != (self.period < 2):
            raise ValueError("damping needs a trend, a season a period of two or more cycles")
        betas, dampings, gammas = self.betas if self.trend else (0.0,), self.dampings if self.damped else (1.0 if self.trend else 0.0,), self.gammas if self.season else (0.0,)
        # smoothing the trend faster than the level, or the season with all that the level leaves, isn't identified
        found = tuple(s for s in product(self.alphas, betas, dampings, gammas) if s[1] <= s[0] and s[3] <= 1 - s[0] + 1e-12)
        object.__setattr__(self, "settings", found)

    @property
    def name(self) -> str:
        letters = {"add": "A", "mul": "M", None: "N"}
        return f"ets({letters[self.error]},{letters[self.trend]}{'d' * self.damped},{letters[self.season]}{f',{self.period}' if self.season else ''})"

    @property
    def least(self) -> int:
        """Cycles that a forecast needs: two for each weight and two more, and two whole seasons."""
        return max(2 * (1 + (self.trend is not None) + self.damped) + 2, 2 * self.period)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _start(form: Form, x: Column) -> Column:
    """The state before the first cycle that counts: its number is ``n``.

    Without a season: the first value, and the first step as trend. With one: the first season's mean, its
    deviations from that (or ratios), and the seasons' difference a cycle as trend.
    """
    none = F.array().cast("array<double>")
    if not form.season:
        level, trend, season, n = F.get(x, F.lit(0)), F.coalesce(F.get(x, F.lit(1)) - F.get(x, F.lit(0)), F.lit(0.0)), none, 1
    else:
        m = form.period
        first, second = F.slice(x, 1, m), F.slice(x, m + 1, m)
        level = _sum(first) / m
        trend = F.when(F.size(second) == m, (_sum(second) - _sum(first)) / (m * m)).otherwise(0.0)
        ratio = lambda v: F.when(level > 0, v / F.nullif(level, F.lit(0.0))).otherwise(1.0)
        season, n = F.transform(first, lambda v: v - level if form.season == "add" else ratio(v)), m
    trend = trend if form.trend else F.lit(0.0)
    return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"), F.lit(0.0).alias("square"), F.lit(0.0).alias("logs"), F.lit(n).alias("n"))


def _expected(form: Form, s: Column, g: Column, steps: Column | None = None) -> Column:
    """The forecast ``steps`` cycles ahead, one by default."""
    grown = g["damping"] if steps is None else F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda a, i: a + F.pow(g["damping"], i.cast("double")))
    level = s["level"] + grown * s["trend"]
    if not form.season:
        return level
    now = F.get(s["season"], F.lit(0) if steps is None else F.pmod(steps - 1, F.lit(form.period)))
    return level + now if form.season == "add" else level * now


def _step(form: Form, s: Column, x: Column, g: Column) -> Column:
    drift = g["damping"] * s["trend"]
    base, expected = s["level"] + drift, _expected(form, s, g)
    miss, season = x - expected, s["season"]
    if form.season == "mul":
        now = F.get(season, F.lit(0))
        own, seasonal = F.when(now > 0, miss / F.nullif(now, F.lit(0.0))).otherwise(0.0), F.when(base > 0, miss / F.nullif(base, F.lit(0.0))).otherwise(0.0)
    else:
        own = seasonal = miss
    if form.season:  # the one in turn goes to the end
        season = F.concat(F.slice(season, 2, form.period - 1), F.array(F.get(season, F.lit(0)) + g["gamma"] * seasonal))
    size = F.greatest(F.abs(expected), F.lit(1e-3))
    weighed = miss if form.error == "add" else miss / size
    logs = s["logs"] + (F.log(size) if form.error == "mul" else 0.0)
    return F.struct((base + g["alpha"] * own).alias("level"), (drift + g["beta"] * own).alias("trend"), season.alias("season"), (s["square"] + weighed * weighed).alias("square"), logs.alias("logs"), (s["n"] + 1).alias("n"))


def _misfit(form: Form, s: Column, skipped: int) -> Column:
    """What the best setting has least: squared errors, or minus the likelihood of relative ones."""
    if form.error == "add":
        return F.round(s["square"], 6)
    n = (s["n"] - skipped).cast("double")
    return F.round(n * F.log(F.greatest(s["square"], F.lit(1e-12))) + 2 * s["logs"], 6)


def _runs(form: Form, g: Column, finish) -> Column:
    """Of the array ``x`` of a series under the setting ``g``: ``finish(state, misfit)`` before each cycle and
    after the last. The cycles of the start have the state before the first that counts."""
    skipped = form.period or 1
    tell = lambda s: F.array(finish(s, _misfit(form, s, skipped)))
    first = F.struct(_start(form, F.col("x")).alias("s"), F.array_repeat(finish(_start(form, F.col("x")), F.lit(0.0)), skipped).alias("out"))
    counted = F.slice("x", skipped + 1, F.greatest(F.size("x") - skipped, F.lit(0)))
    step = lambda a, v: F.struct(_step(form, a["s"], v, g).alias("s"), F.concat(a["out"], tell(a["s"])).alias("out"))
    return F.aggregate(counted, first, step, lambda a: F.concat(a["out"], tell(a["s"])))


def _fitted(panel: DataFrame, form: Form, finish, kept: list[str]) -> DataFrame:
    """``(serie, s, best)``: the cycles in order, and before each of them and after the last the best setting's
    ``misfit`` and what ``finish(state, g)`` gave for it under the names ``kept``. Ties take the first setting."""
    cycle = F.struct("opening_date", "cycle", F.col("items").cast("double").alias("x"))
    rows = panel.groupBy("serie").agg(F.array_sort(F.collect_list(cycle)).alias("s")).withColumn("x", F.transform("s", lambda v: v["x"]))
    names = ("alpha", "beta", "damping", "gamma")
    grid = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(names, setting))) for setting in form.settings))

    def told(g: Column) -> Column:
        return _runs(form, g, lambda s, misfit: F.struct(misfit.alias("misfit"), *(c.alias(k) for k, c in zip(kept, finish(s, g)))))

    best = F.aggregate(F.slice(grid, 2, len(form.settings)), told(F.get(grid, F.lit(0))), lambda a, g: F.zip_with(a, told(g), lambda p, q: F.when(q["misfit"] < p["misfit"], q).otherwise(p)))
    return rows.select("serie", "s", best.alias("best"))


def backtest(panel: DataFrame, form: Form, **options: int) -> DataFrame:
    """Points of all origins: each series and origin with the weights that fit the cycles before it best.

    Series with fewer cycles than ``form.least`` before an origin have no point there; none is below 0.
    """
    fitted = _fitted(panel, form, lambda s, g: [_expected(form, s, g)], ["value"])
    rows = fitted.select("serie", F.posexplode(F.arrays_zip("s", F.slice("best", 1, F.size("s")).alias("b"))).alias("before", "r"))
    rows = rows.where(F.col("before") >= form.least).select("serie", "r.s.cycle", F.col("r.s.x").alias("actual"), floored(F.col("r.b.value")).alias("predicted"))
    rows = rows.join(F.broadcast(origins(panel, **options)), "cycle")
    return rows.select(F.lit(form.name).alias("candidate"), "serie", "cycle", "origin", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))


def forecast(panel: DataFrame, form: Form, steps: int) -> DataFrame:
    """``(candidate, serie, step, predicted)`` for the cycles after the last, from the whole history."""
    ahead = F.sequence(F.lit(1), F.lit(steps))
    fitted = _fitted(panel, form, lambda s, g: [F.transform(ahead, lambda h: _expected(form, s, g, h))], ["values"])
    rows = fitted.where(F.size("s") >= form.least).select("serie", F.posexplode(F.element_at("best", -1)["values"]).alias("at", "v"))
    return rows.select(F.lit(form.name).alias("candidate"), "serie", (F.col("at") + 1).alias("step"), floored(F.col("v")).alias("predicted"))


# -- weights shared by all series -------------------------------------------------------------------

#: Smoothing weights, and exponents by which items scale with the length of a window.
ALPHAS, EXPONENTS = tuple(i / 100 for i in range(1, 101)), tuple(i / 10 for i in range(11))


def shared_levels(panel: DataFrame, alphas: tuple[float, ...] = ALPHAS, exponents: tuple[float, ...] = EXPONENTS) -> DataFrame:
    """``(serie, exponent, levels, errors)``: per exponent, the last level and the summed one-step error of each weight.

    A series is scaled and folded once per exponent; all weights go through that fold together, as arrays.
    """
    cycle = F.struct("opening_date", F.col("items").cast("double").alias("x"), F.col("cycle_days").cast("double").alias("d"))
    rows = panel.groupBy("serie").agg(F.array_sort(F.collect_list(cycle)).alias("s"))
    rows = rows.select("serie", "s", F.explode(F.array(*(F.lit(float(e)) for e in exponents))).alias("exponent"))
    weights = F.array(*(F.lit(float(a)) for a in alphas))
    scaled = F.transform("s", lambda v: F.struct((v["x"] / F.pow(v["d"], F.col("exponent"))).alias("y"), F.pow(v["d"], F.col("exponent")).alias("scale")))
    rows = rows.select("serie", "exponent", scaled.alias("s"))
    first = F.struct(F.array_repeat(F.get("s", F.lit(0))["y"], len(alphas)).alias("levels"), F.array_repeat(F.lit(0.0), len(alphas)).alias("errors"))

    def step(a: Column, v: Column) -> Column:
        errors = F.zip_with(a["errors"], a["levels"], lambda e, level: e + F.abs(v["y"] - level) * v["scale"])
        return F.struct(F.zip_with(a["levels"], weights, lambda level, w: level + w * (v["y"] - level)).alias("levels"), errors.alias("errors"))

    folded = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), first, step)
    return rows.select("serie", "exponent", folded.alias("f")).select("serie", "exponent", "f.levels", "f.errors")


def shared_choice(levels: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """One row: the weight and exponent of the least error over all series; ties to the smaller weight, then exponent."""
    each = levels.select("exponent", F.posexplode("errors").alias("at", "error")).groupBy("exponent", "at").agg(F.sum("error").alias("error"))
    best = each.agg(F.min_by(F.struct("at", "exponent", "error"), F.struct(F.round("error", 6), "at", "exponent")).alias("b"))
    return best.select(F.get(F.array(*(F.lit(float(a)) for a in alphas)), F.col("b.at")).alias("alpha"), "b.exponent", "b.error", F.col("b.at").alias("at"))


def shared_forecast(panel: DataFrame, windows: DataFrame, alphas: tuple[float, ...] = ALPHAS, exponents: tuple[float, ...] = EXPONENTS) -> DataFrame:
    """``windows`` with ``predicted``: the series' level under the shared choice times the window's own length to
    the exponent; null for series without history."""
    levels = shared_levels(panel, alphas, exponents).checkpoint()
    chosen = levels.join(F.broadcast(shared_choice(levels, alphas).select("exponent", "at")), "exponent")
    own = chosen.select("serie", F.get("levels", F.col("at")).alias("_level"), F.col("exponent").alias("_e"))
    value = floored(F.col("_level") * F.pow(F.col("cycle_days").cast("double"), F.col("_e")))
    return windows.join(own, "serie", "left").withColumn("predicted", value).drop("_level", "_e")
