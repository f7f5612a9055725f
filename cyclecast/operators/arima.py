"""ARIMA of any order per series by least squares, all origins in one plan.

In the way of Hannan and Rissanen: a long autoregression tells the shocks, then values are regressed on
their own lags and those of the shocks. Both regressions are running sums of products over a series'
window, so every cycle has the coefficients of what came before it, and the shocks are forecast errors
that never look ahead. The normal equations are solved by elimination in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators.folds import floored, origins

#: A regressor whose pivot falls below this part of its own square sum is a combination of others: coefficient 0.
LEAST_PIVOT = 1e-9


def _series() -> Window:
    return Window.partitionBy("serie").orderBy("opening_date")


def regressed(rows: DataFrame, target: str, inputs: list[str], name: str, inclusive: bool = False) -> DataFrame:
    """``rows`` with the array ``name``: least-squares coefficients of ``inputs`` for ``target`` over the
    rows of the series before each one (or up to it), those with a null aside; and ``name_n``, their number."""
    span = _series().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    k = len(inputs)
    whole = F.lit(True)
    for c in (target, *inputs):
        whole = whole & F.col(c).isNotNull()
    columns = [*inputs, target]
    sums = {f"_s{i}_{j}": F.coalesce(F.sum(F.when(whole, F.col(columns[i]) * F.col(columns[j]))).over(span), F.lit(0.0)) for i in range(k) for j in range(i, k + 1)}
    rows = rows.withColumns(sums | {f"{name}_n": F.count(F.when(whole, 1)).over(span)})
    matrix = F.array(*(F.array(*(F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(k + 1))) for i in range(k)))
    squares = F.array(*(F.col(f"_s{i}_{i}") for i in range(k)))
    return rows.withColumn(name, _solved(matrix, squares, k)).drop(*sums)


def _solved(matrix: Column, squares: Column, k: int) -> Column:
    """The solution of ``k`` normal equations, the rows of ``matrix`` with their right-hand sides last."""
    usable = lambda m, j: F.get(F.get(m, j), j) > LEAST_PIVOT * F.get(squares, j)

    def eliminate(m: Column, j: Column) -> Column:
        own = F.get(m, j)
        cleared = lambda row: F.zip_with(row, own, lambda a, b: a - F.get(row, j) / F.get(own, j) * b)
        return F.when(usable(m, j), F.transform(m, lambda row, i: F.when(i == j, row).otherwise(cleared(row)))).otherwise(m)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix, eliminate)
    return F.transform(done, lambda row, i: F.when(F.get(row, i) > LEAST_PIVOT * F.get(squares, i), F.get(row, F.lit(k)) / F.get(row, i)).otherwise(0.0))


def _dot(name: str, inputs: list[str]) -> Column:
    found = F.lit(0.0)
    for i, c in enumerate(inputs):
        found = found + F.get(name, F.lit(i)) * F.col(c)
    return found


def least(p: int, d: int, q: int) -> int:
    """Cycles of history that a forecast needs."""
    return d + 2 * (p + q) + 2


def _prepared(panel: DataFrame, p: int, d: int, q: int) -> tuple[DataFrame, list[str]]:
    """``(serie, cycle, opening_date, x, z, e, lags of both, _r)`` and the names of the regressors."""
    if min(p, d, q) < 0 or p + q == 0 or d > 2:
        raise ValueError("an order has p + q of 1 or more and d of 0 to 2")
    w = _series()
    x = F.col("items").cast("double")
    lag = lambda c, n: F.lag(c, n).over(w)
    rows = panel.select("serie", "cycle", "opening_date", x.alias("x"))
    rows = rows.withColumns({"_r": F.row_number().over(w), "one": F.lit(1.0), "x1": lag("x", 1), "x2": lag("x", 2)})
    z = {0: F.col("x"), 1: F.col("x") - F.col("x1"), 2: F.col("x") - 2 * F.col("x1") + F.col("x2")}[d]
    rows = rows.withColumn("z", z)
    long = p + q if q else p
    rows = rows.withColumns({f"z{i}": lag("z", i) for i in range(1, long + 1)})
    constant = [] if d else ["one"]
    if q:
        inputs = [*constant, *(f"z{i}" for i in range(1, long + 1))]
        rows = regressed(rows, "z", inputs, "a")
        enough = F.col("a_n") > len(inputs)
        rows = rows.withColumn("e", F.when(enough & F.col(f"z{long}").isNotNull(), F.col("z") - _dot("a", inputs)).otherwise(0.0))
        rows = rows.withColumns({f"e{i}": lag("e", i) for i in range(1, q + 1)})
    return rows, [*constant, *(f"z{i}" for i in range(1, p + 1)), *(f"e{i}" for i in range(1, q + 1))]


def backtest(panel: DataFrame, p: int, d: int, q: int, **options: int) -> DataFrame:
    """Points of all origins, each with coefficients from the cycles before it; none is below 0.

    A series with fewer than ``least`` cycles before an origin has no point there. There is a constant
    where d is 0.
    """
    rows, inputs = _prepared(panel, p, d, q)
    rows = regressed(rows, "z", inputs, "b")
    back = {0: F.lit(0.0), 1: F.col("x1"), 2: 2 * F.col("x1") - F.col("x2")}[d]
    rows = rows.where(F.col("_r") > least(p, d, q)).select("serie", "cycle", F.col("x").alias("actual"), floored(_dot("b", inputs) + back).alias("predicted"))
    rows = rows.where("predicted is not null").join(F.broadcast(origins(panel, **options)), "cycle")
    return rows.select(F.lit(f"arima({p},{d},{q})").alias("candidate"), "serie", "cycle", "origin", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))


def forecast(panel: DataFrame, p: int, d: int, q: int, steps: int) -> DataFrame:
    """``(candidate, serie, step, predicted)`` for the cycles after the last: shocks to come are 0."""
    rows, inputs = _prepared(panel, p, d, q)
    rows = regressed(rows, "z", inputs, "b", inclusive=True)
    newest = lambda c, n: F.array(*([F.coalesce(c if not i else F.lag(c, i).over(_series()), F.lit(0.0)) for i in range(n)] or [F.lit(0.0)]))
    rows = rows.withColumns({"_z": newest(F.col("z"), p), "_e": newest(F.col("e") if q else F.lit(0.0), q), "_last": F.row_number().over(Window.partitionBy("serie").orderBy(F.desc("opening_date"))), "_x1": F.lag("x", 1).over(_series())})
    last = rows.where((F.col("_last") == 1) & (F.col("_r") >= least(p, d, q)))
    at = len(inputs) - p - q
    constant = F.get("b", F.lit(0)) if at else F.lit(0.0)

    def step(a: Column, _: Column) -> Column:
        value = constant
        for i in range(p):
            value = value + F.get("b", F.lit(at + i)) * a["z"][i]
        for i in range(q):
            value = value + F.get("b", F.lit(at + p + i)) * a["e"][i]
        x = {0: value, 1: value + a["x"], 2: value + 2 * a["x"] - a["before"]}[d]
        shifted = lambda v, new: F.concat(F.array(new), F.slice(v, 1, F.size(v) - 1))
        return F.struct(shifted(a["z"], value).alias("z"), shifted(a["e"], F.lit(0.0)).alias("e"), x.alias("x"), a["x"].alias("before"), F.concat(a["out"], F.array(x)).alias("out"))

    start = F.struct(F.col("_z").alias("z"), F.col("_e").alias("e"), F.col("x").alias("x"), F.coalesce("_x1", F.lit(0.0)).alias("before"), F.array().cast("array<double>").alias("out"))
    told = last.select("serie", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["out"])).alias("i", "v"))
    return told.select(F.lit(f"arima({p},{d},{q})").alias("candidate"), "serie", (F.col("i") + 1).alias("step"), floored(F.col("v")).alias("predicted"))
