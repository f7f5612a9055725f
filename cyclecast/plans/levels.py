"""Queries on level strategies, recursive paths and closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import calibrate, folds, levels, paths
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STEPS, HOLDOUT = [1, 2, 3], 3


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.item_panel(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


def totals_and_cycles(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals per sector before the last ``HOLDOUT`` cycles, the cycles, and the totals held out."""
    cycles = folds.cycle_index(p).select("cycle", F.col("idx").cast("long").alias("cycle_id"), F.col("opening_date").alias("open_date")).checkpoint()
    all_totals = p.groupBy("sector", "cycle").agg(F.sum("items").cast("double").alias("cycle_total")).join(F.broadcast(cycles), "cycle").select("sector", "cycle_id", "cycle_total").checkpoint()
    last = F.broadcast(cycles.agg((F.max("cycle_id") - HOLDOUT).alias("_cut")))
    split = all_totals.crossJoin(last)
    return split.where("cycle_id <= _cut").drop("_cut"), cycles.select("cycle_id", "open_date"), split.where("cycle_id > _cut").drop("_cut")


TOTALS = """
lidx AS (SELECT cycle, opening_date, row_number() OVER (ORDER BY opening_date, cycle) AS cycle_id FROM (SELECT DISTINCT cycle, opening_date FROM panel)),
totals_all AS (SELECT sector, cycle_id, min(opening_date) AS open_date, CAST(sum(items) AS DOUBLE) AS y FROM (SELECT p.sector, p.items, l.cycle_id, l.opening_date FROM panel p JOIN lidx l USING (cycle)) GROUP BY ALL),
cut AS (SELECT max(cycle_id) - 3 AS c FROM lidx),
totals AS (SELECT * FROM totals_all, cut WHERE cycle_id <= c),
held AS (SELECT sector, cycle_id, y FROM totals_all, cut WHERE cycle_id > c),
steps AS (SELECT unnest([1, 2, 3]) AS step),
ends AS (SELECT sector, arg_max(y, cycle_id) AS y FROM totals GROUP BY sector),
trends AS (SELECT sector, coalesce(regr_slope(y, x), 0) AS slope FROM (SELECT sector, y, row_number() OVER (PARTITION BY sector ORDER BY cycle_id) AS x FROM totals) GROUP BY sector),
naive AS (SELECT 'naive_last' AS strategy, sector, c + step AS cycle_id, y AS f FROM ends, steps, cut),
trend AS (SELECT 'linear_trend' AS strategy, sector, c + step AS cycle_id, greatest(0.0, y + slope * step) AS f FROM ends JOIN trends USING (sector), steps, cut),
centred AS (SELECT sector, avg(cycle_id) AS ma, avg(month(open_date)) AS mb, avg(y) AS my, var_pop(cycle_id) AS aa, var_pop(month(open_date)) AS bb, covar_pop(cycle_id, month(open_date)) AS ab, covar_pop(cycle_id, y) AS ay, covar_pop(month(open_date), y) AS bym FROM totals GROUP BY sector),
solved AS (SELECT *, CASE WHEN aa * bb - ab * ab > 1e-9 * aa * bb THEN (ay * bb - bym * ab) / (aa * bb - ab * ab) WHEN aa > 0 THEN ay / aa ELSE 0 END AS ka, CASE WHEN aa * bb - ab * ab > 1e-9 * aa * bb THEN (bym * aa - ay * ab) / (aa * bb - ab * ab) WHEN aa <= 0 AND bb > 0 THEN bym / bb ELSE 0 END AS kb FROM centred),
regression AS (SELECT 'calendar_regression' AS strategy, sector, l.cycle_id, greatest(0.0, my + ka * (l.cycle_id - ma) + kb * (month(l.opening_date) - mb)) AS f FROM solved, cut JOIN lidx l ON l.cycle_id > c)"""


def _columns(name: str) -> str:
    return sql(f"SELECT strategy, sector, CAST(cycle_id AS BIGINT) AS cycle_id, round(f, 4) AS forecast_cycle_total FROM {name}", "panel", TOTALS)


@query("level_naive_last", _columns("naive"))
def naive(p):
    totals, _, _ = totals_and_cycles(p)
    return rounded(levels.naive_last(totals, STEPS), 4)


@query("level_linear_trend", _columns("trend"))
def trend(p):
    totals, _, _ = totals_and_cycles(p)
    return rounded(levels.linear_trend(totals, STEPS), 4)


@query("level_calendar_regression", _columns("regression"))
def regression(p):
    totals, cycles, _ = totals_and_cycles(p)
    return rounded(levels.calendar_regression(totals, cycles, STEPS), 4)


@query("level_scoreboard", sql("""
WITH f AS (SELECT * FROM naive UNION ALL SELECT * FROM trend UNION ALL SELECT * FROM regression),
e AS (SELECT strategy, f - h.y AS e, h.y FROM f JOIN held h USING (sector, cycle_id)),
m AS (SELECT strategy, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, sum(abs(e)) / sum(y) AS wmape, avg(e) AS bias FROM e GROUP BY strategy)
SELECT strategy, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(wmape, 4) AS wmape, round(bias, 4) AS bias, row_number() OVER (ORDER BY mae, strategy) AS place FROM m""", "panel", TOTALS))
def level_scoreboard(p):
    totals, cycles, held = totals_and_cycles(p)
    found = levels.naive_last(totals, STEPS).unionByName(levels.linear_trend(totals, STEPS)).unionByName(levels.calendar_regression(totals, cycles, STEPS))
    return rounded(levels.scoreboard(found, held), 4)


@query("level_fitted")
def fitted(p):
    totals, _, _ = totals_and_cycles(p)
    return levels.fitted_per_sector(totals, "holt", levels.smoothed, STEPS).unionByName(levels.fitted_per_sector(totals, "arima_110", levels.differenced_autoregression, STEPS))


@query("recursive_path", sql("""
WITH RECURSIVE last5 AS (SELECT serie, list(x ORDER BY opening_date) AS h FROM (SELECT serie, opening_date, CAST(items AS DOUBLE) AS x, row_number() OVER (PARTITION BY serie ORDER BY opening_date DESC) AS r FROM panel) WHERE r <= 5 GROUP BY serie),
walk AS (SELECT serie, 0 AS step, h, CAST(NULL AS DOUBLE) AS predicted FROM last5
  UNION ALL SELECT serie, step + 1, list_append(h, list_avg(h[-5:])), list_avg(h[-5:]) FROM walk WHERE step < 6)
SELECT serie, CAST(step AS BIGINT) AS step, round(predicted, 6) AS predicted FROM walk WHERE step > 0""", "panel").replace("WITH", "WITH RECURSIVE", 1).replace(", RECURSIVE last5", ", last5"))
def recursive(p):
    return paths.moving_average_path(p, window=5, steps=6)


@query("leave_one_out_effects", sql("""
WITH w AS (SELECT serie, cycle, CAST(items AS DOUBLE) AS actual, lag(items, 1) OVER s AS a, lag(items, 2) OVER s AS b, lag(items, 17) OVER s AS c FROM panel WINDOW s AS (PARTITION BY serie ORDER BY opening_date)),
k AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
v AS (SELECT v.variant, abs(actual - v.f) AS e FROM k, LATERAL (VALUES ('full', (a + b + c) / 3.0), ('without lag_1', (b + c) / 2.0), ('without lag_2', (a + c) / 2.0), ('without lag_17', (a + b) / 2.0)) v(variant, f)),
m AS (SELECT variant, avg(e) AS mae FROM v GROUP BY variant)
SELECT variant, round(mae, 6) AS mae, round(mae - (SELECT mae FROM m WHERE variant = 'full'), 6) AS effect FROM m""", "panel"))
def ablation(p):
    return paths.leave_one_out(p, {"lag_1": 1, "lag_2": 2, "lag_17": 17})


@query("model_size", sql("""
WITH n AS (SELECT count(DISTINCT sector) AS s FROM panel), days AS (SELECT sum(d) AS d, count(*) AS h FROM (SELECT max(cycle_days) AS d FROM panel GROUP BY cycle ORDER BY cycle DESC LIMIT 3))
SELECT CAST(s * 15 AS BIGINT) AS binary_variables, CAST(2 * h AS BIGINT) AS continuous_variables, CAST(s + 2 * d + least(9, s) * d + 1 AS BIGINT) AS constraints FROM n, days""", "panel"))
def size(p):
    lengths = p.groupBy("cycle").agg(F.max("cycle_days").alias("d")).orderBy(F.desc("cycle")).limit(3)
    return paths.model_size(p.agg(F.count_distinct("sector").alias("sectors")), lengths, slots=15, cds=9)


@query("rank_rule", sql("""
WITH RECURSIVE m AS (SELECT sector AS config, avg(items) AS gap_mean, quantile_cont(items, 0.9) AS gap_p90, count(DISTINCT city) AS complexity FROM panel GROUP BY sector),
walk AS (SELECT 0 AS place, CAST(NULL AS VARCHAR) AS best, list({'c': complexity, 'g': gap_mean, 'n': config, 'p': gap_p90}) AS rest FROM m
  UNION ALL SELECT place + 1, pick.n, list_filter(rest, lambda x: x.n <> pick.n) FROM (
    SELECT place, rest, list_min(list_filter(tied, lambda x: x.p <= low_p + 5)) AS pick FROM (
      SELECT place, rest, tied, list_min(list_transform(tied, lambda x: x.p)) AS low_p FROM (
        SELECT place, rest, list_filter(rest, lambda x: x.g <= low + 5) AS tied FROM (
          SELECT place, rest, list_min(list_transform(rest, lambda x: x.g)) AS low FROM walk WHERE len(rest) > 0)))))
SELECT config, round(gap_mean, 6) AS gap_mean, round(gap_p90, 6) AS gap_p90, CAST(complexity AS BIGINT) AS complexity, CAST(place AS BIGINT) AS place FROM walk JOIN m ON m.config = best""", "panel").replace("WITH", "WITH RECURSIVE", 1).replace(", RECURSIVE m", ", m"))
def rank_rule(p):
    """Sectors in place of configurations, their items in place of gaps."""
    rows = p.groupBy(F.col("sector").alias("config")).agg(F.avg("items").alias("gap_mean"), F.percentile("items", F.lit(0.9)).alias("gap_p90"), F.count_distinct("city").alias("complexity"))
    return calibrate.rank_by_rule(rows.withColumn("gap_p90", F.col("gap_p90").cast("double")), 5.0)
