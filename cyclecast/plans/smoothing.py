"""Queries on exponential smoothing with trend and season, and on weights shared by all series."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclecast.operators import smoothing
from cyclecast.plans import tables
from cyclecast.plans.backtests import INDEX
from cyclecast.plans.panels import rounded
from cyclecast.plans.scenarios import ASKED, questions
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAMPED = smoothing.Form(trend="add", damped=True)
SEASONAL = smoothing.Form(season="add", period=17)
RELATIVE = smoothing.Form(error="mul", trend="add")


def query(name: str, oracle: str | None = None, digits: int = 6):
    """Registers a function of the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.item_panel(spark, sf_dir)), digits)
        if oracle:
            ORACLE_SQL[name] = oracle.replace("WITH ", "WITH RECURSIVE ", 1)
        return function

    return register


def grid(form: smoothing.Form) -> str:
    rows = ", ".join(f"({k}, {a}, {b}, {d}, {g})" for k, (a, b, d, g) in enumerate(form.settings))
    return f"grid AS (SELECT CAST(k AS INTEGER) AS k, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, CAST(phi AS DOUBLE) AS phi, CAST(gamma AS DOUBLE) AS gamma FROM (VALUES {rows}) v(k, alpha, beta, phi, gamma))"


RANKED = "ranked AS (SELECT serie, cycle, opening_date, CAST(cycle_days AS DOUBLE) AS d, CAST(items AS DOUBLE) AS x, CAST(row_number() OVER (PARTITION BY serie ORDER BY opening_date) AS INTEGER) AS r FROM panel)"
#: One fold a series and setting: levels and trends from the first two values on.
TREND = """
starts AS (SELECT serie, min(x) FILTER (r = 1) AS x1, min(x) FILTER (r = 2) AS x2 FROM ranked GROUP BY serie),
run AS (
  SELECT serie, k, alpha, beta, phi, 1 AS r, x1 AS level, coalesce(x2 - x1, 0.0) AS trend, CAST(0 AS DOUBLE) AS square, CAST(0 AS DOUBLE) AS logs FROM starts, grid
  UNION ALL
  SELECT serie, k, alpha, beta, phi, r + 1, f + alpha * (x - f), phi * trend + beta * (x - f), square + (x - f) * (x - f) / scale / scale, logs + ln(scale)
  FROM (SELECT run.*, x, level + phi * trend AS f, {scale} AS scale FROM run JOIN ranked ON ranked.serie = run.serie AND ranked.r = run.r + 1)),
told AS (SELECT serie, r + 1 AS r, k, level + phi * trend AS f, {misfit} AS misfit FROM run)"""
POINTS = """
WITH best AS (SELECT serie, r, arg_min(f, (misfit, k)) AS f FROM told GROUP BY serie, r),
p AS (SELECT serie, cycle, origin, x AS actual, greatest(f, 0.0) AS predicted FROM ranked JOIN best USING (serie, r) JOIN origins USING (cycle) WHERE r - 1 >= {least})
SELECT '{name}' AS candidate, serie, cycle, origin, actual, round(predicted, 6) AS predicted, round(abs(actual - predicted), 6) AS abs_error FROM p"""


def points(form: smoothing.Form) -> str:
    return POINTS.format(least=form.least, name=form.name)


@query("ets_trend_damped", sql(points(DAMPED), "panel", INDEX, RANKED, grid(DAMPED), TREND.format(scale="1.0", misfit="round(square, 6)")))
def damped(p):
    return smoothing.backtest(p, DAMPED)


@query("ets_relative_errors", sql(points(RELATIVE), "panel", INDEX, RANKED, grid(RELATIVE), TREND.format(scale="greatest(abs(level + phi * trend), 0.001)", misfit="round((r - 1) * ln(greatest(square, 1e-12)) + 2 * logs, 6)")))
def relative(p):
    return smoothing.backtest(p, RELATIVE)


SEASONS = """
starts AS (SELECT serie, avg(x) AS level, list(x ORDER BY r) AS xs FROM ranked WHERE r <= 17 GROUP BY serie HAVING count(*) = 17),
run AS (
  SELECT serie, k, alpha, gamma, 17 AS r, level, list_transform(xs, lambda v: v - level) AS season, CAST(0 AS DOUBLE) AS square FROM starts, grid
  UNION ALL
  SELECT serie, k, alpha, gamma, r + 1, level + alpha * e, list_append(season[2:17], season[1] + gamma * e), square + e * e
  FROM (SELECT run.*, x - level - season[1] AS e FROM run JOIN ranked ON ranked.serie = run.serie AND ranked.r = run.r + 1)),
told AS (SELECT serie, r + 1 AS r, k, level + season[1] AS f, round(square, 6) AS misfit FROM run)"""


@query("ets_seasonal", sql(points(SEASONAL), "panel", INDEX, RANKED, grid(SEASONAL), SEASONS))
def seasonal(p):
    return smoothing.backtest(p, SEASONAL)


@query("ets_forecast", sql("""
WITH lasts AS (SELECT serie, max(r) AS n FROM ranked GROUP BY serie HAVING max(r) >= 8),
best AS (SELECT run.serie, arg_min(struct_pack(level, trend, phi), (round(square, 6), k)) AS s FROM run JOIN lasts ON lasts.serie = run.serie AND lasts.n = run.r GROUP BY run.serie)
SELECT 'ets(A,Ad,N)' AS candidate, serie, CAST(h AS BIGINT) AS step, round(greatest(s.level + s.trend * list_sum(list_transform(range(1, h + 1), lambda i: power(s.phi, i))), 0.0), 6) AS predicted
FROM best, (SELECT unnest(range(1, 6)) AS h)""", "panel", RANKED, grid(DAMPED), TREND.format(scale="1.0", misfit="square")))
def ahead(p):
    """Five cycles beyond the last."""
    return smoothing.forecast(p, DAMPED, 5)


SHARED = """
shared AS (
  SELECT serie, a, e, 1 AS r, x / power(d, e) AS level, CAST(0 AS DOUBLE) AS error FROM {rows}, (SELECT unnest(range(1, 101)) / 100.0::DOUBLE AS a), (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS e) WHERE r = 1
  UNION ALL
  SELECT serie, a, e, r + 1, level + a * (y - level), error + abs(y - level) * scale
  FROM (SELECT s.*, x / power(d, s.e) AS y, power(d, s.e) AS scale FROM shared s JOIN {rows} h ON h.serie = s.serie AND h.r = s.r + 1)),
ends AS (SELECT s.* FROM shared s JOIN (SELECT serie, max(r) AS r FROM {rows} GROUP BY serie) USING (serie, r)),
choice AS (SELECT a, e, sum(error) AS error FROM ends GROUP BY a, e ORDER BY round(sum(error), 6), a, e LIMIT 1)"""


@query("ets_pooled_grid", sql("SELECT a AS alpha, e AS exponent, round(error, 4) AS error FROM choice", "panel", RANKED, SHARED.format(rows="ranked")), 4)
def pooled_grid(p):
    """The best of 100 weights and 11 exponents."""
    return smoothing.shared_choice(smoothing.shared_levels(p)).select("alpha", "exponent", "error")


@query("ets_pooled_forecast", sql("""
SELECT q.serie, q.cycle, q.window_start, CAST(q.cycle_days AS BIGINT) AS cycle_days, round(greatest(l.level * power(CAST(q.cycle_days AS DOUBLE), l.e), 0.0), 4) AS predicted
FROM asked q LEFT JOIN (SELECT serie, level, ends.e FROM ends JOIN choice ON choice.a = ends.a AND choice.e = ends.e) l ON l.serie = q.serie""", "panel", ASKED, RANKED.replace("ranked AS", "past AS").replace("FROM panel", "FROM hist"), SHARED.format(rows="past")), 4)
def pooled_forecast(p):
    """The last cycle's windows, moved and made longer, from the cycles before it."""
    history, asked = questions(p)
    return smoothing.shared_forecast(history, asked).select("serie", "cycle", "window_start", F.col("cycle_days").cast("long").alias("cycle_days"), "predicted")
