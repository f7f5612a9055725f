"""Queries on the item panel: features, back-tests, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import evaluate, features, folds
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, digits: int = 6):
    """Registers a function of the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.item_panel(spark, sf_dir)), digits)
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


W = "OVER (PARTITION BY serie ORDER BY opening_date"
INDEX = """
idx AS (SELECT cycle, opening_date, row_number() OVER (ORDER BY opening_date, cycle) AS i FROM (SELECT DISTINCT cycle, opening_date FROM panel)),
origins AS (SELECT cycle, i AS origin FROM idx WHERE i > 20)"""


def points(name: str, prediction: str, source: str = "panel") -> str:
    return f"""
WITH p AS (SELECT serie, cycle, CAST(items AS DOUBLE) AS actual, greatest({prediction}, 0.0) AS predicted FROM {source})
SELECT '{name}' AS candidate, serie, cycle, origin, actual, round(predicted, 6) AS predicted, round(abs(actual - predicted), 6) AS abs_error
FROM p JOIN origins USING (cycle) WHERE predicted IS NOT NULL"""


def backtest_sql(name: str, prediction: str) -> str:
    # greatest() skips nulls, and a window can't be tested for null in the same select
    return sql(points(name, prediction).replace(f"greatest({prediction}, 0.0)", f"CASE WHEN ({prediction}) IS NULL THEN NULL ELSE greatest({prediction}, 0.0) END"), "panel", INDEX)


def _select(columns: str) -> str:
    return sql(f"SELECT serie, cycle, {columns} FROM panel", "panel")


@query("feat_lags", _select(", ".join(f"lag(items, {n}) {W}) AS items_lag_{n}" for n in (1, 2, 3, 4))))
def feat_lags(p):
    return p.select("serie", "cycle", *features.lags([1, 2, 3, 4]))


@query("feat_rolling_full", _select(", ".join(f"round(CASE WHEN count(items) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg(items) {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, 6) AS items_mean_{n}" for n in (3, 6))))
def feat_rolling(p):
    return p.select("serie", "cycle", *features.full_means([3, 6]))


@query("feat_expanding_level_ref", _select(f"round(avg(items) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS level_ref"))
def feat_level(p):
    return p.select("serie", "cycle", features.level_ref())


@query("feat_companion_lags", _select(f"lag(orders, 1) {W}) AS orders_lag_1, lag(volumes, 1) {W}) AS volumes_lag_1"))
def feat_companion(p):
    return p.select("serie", "cycle", *features.lags([1], "orders"), *features.lags([1], "volumes"))


@query("feat_items_per_order", _select(f"round(lag(items / nullif(orders, 0), 1) {W}), 6) AS items_per_order_lag_1"))
def feat_ipo(p):
    return p.select("serie", "cycle", *features.items_per_order_lags([1]))


@query("feat_window_gap", _select(f"lag(window_start) {W}) AS previous_start, CAST(window_start - lag(window_start) {W}) AS BIGINT) AS days_since_previous, day(window_start) AS opening_day_of_month"))
def feat_gap(p):
    return p.select("serie", "cycle", *features.window_features())


@query("feat_calendar", _select("CAST(right(cycle, 2) AS BIGINT) AS cycle_number, month(opening_date) AS cycle_month, quarter(opening_date) AS cycle_quarter"))
def feat_calendar(p):
    return p.select("serie", "cycle", *features.calendar_features())


@query("feat_momentum", sql(f"""
WITH f AS (SELECT serie, cycle, lag(items, 1) {W}) AS l1, lag(items, 2) {W}) AS l2, CASE WHEN count(items) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN avg(items) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS m FROM panel)
SELECT serie, cycle, l1 - l2 AS momentum, round(l1 / nullif(m, 0), 6) AS momentum_ratio FROM f""", "panel"))
def feat_momentum(p):
    return features.build(p).select("serie", "cycle", *features.momentum())


@query("feat_trainable", sql(f"""
WITH f AS (SELECT serie, cycle, lag(items, 4) {W}) AS l4, count(items) {W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n, avg(items) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM panel)
SELECT serie, cycle, round(r, 6) AS level_ref FROM f WHERE l4 IS NOT NULL AND n = 6 AND r > 0""", "panel"))
def feat_trainable(p):
    return features.trainable(features.build(p), ["items_lag_4", "items_mean_6"], True).select("serie", "cycle", "level_ref")


@query("closed_history_asof", sql("""
SELECT a.serie, a.cycle, a.opening_date, count(b.closing_date) AS n_closed, arg_max(b.items, b.closing_date) AS last_closed_items
FROM panel a LEFT JOIN panel b ON a.serie = b.serie AND b.closing_date < a.opening_date GROUP BY ALL""", "panel"))
def closed(p):
    return features.closed_before(p)


@query("naive_last_backtest", backtest_sql("naive:last", f"lag(items, 1) {W})"))
def naive_last(p):
    return folds.scored(p, "naive:last", folds.last_value())


@query("naive_mean_backtest", backtest_sql("naive:mean", f"avg(items) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def naive_mean(p):
    return folds.scored(p, "naive:mean", folds.mean())


@query("naive_seasonal_backtest", backtest_sql("naive:seasonal17", f"lag(items, 17) {W})"))
def naive_seasonal(p):
    return folds.scored(p, "naive:seasonal17", folds.seasonal(17))


@query("moving_average_backtest", backtest_sql("moving_average:5", f"avg(items) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"))
def moving(p):
    return folds.scored(p, "moving_average:5", folds.moving_average(5))


FACTORS = f"""
means AS (SELECT *, avg(items) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM panel),
factors AS (SELECT opening_date, sum(items) / sum(m) AS factor FROM means WHERE m > 0 GROUP BY opening_date),
dates AS (SELECT DISTINCT p.opening_date, factor FROM panel p LEFT JOIN factors f ON f.opening_date = p.opening_date)"""


def factor_sql(name: str, used: str) -> str:
    return sql(f"""
WITH seen AS (SELECT opening_date, coalesce({used}, 1.0) AS used FROM dates),
q AS (SELECT means.*, m * used AS pred FROM means JOIN seen USING (opening_date))
SELECT '{name}' AS candidate, serie, cycle, origin, CAST(items AS DOUBLE) AS actual, round(pred, 6) AS predicted, round(abs(items - pred), 6) AS abs_error
FROM q JOIN origins USING (cycle) WHERE pred IS NOT NULL""", "panel", INDEX, FACTORS)


@query("cycle_factor_backtest", factor_sql("cycle_factor:last1", "last_value(factor IGNORE NULLS) OVER (ORDER BY opening_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def factor_last(p):
    return folds.cycle_factor_backtest(p, "last", 1)


@query("cycle_factor_mean3_backtest", factor_sql("cycle_factor:mean3", "avg(factor) OVER (ORDER BY opening_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"))
def factor_mean(p):
    return folds.cycle_factor_backtest(p, "mean", 3)


RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY opening_date) AS r FROM panel),
targets AS (SELECT t.serie, t.cycle, o.origin, t.items, t.r FROM ranked t JOIN origins o USING (cycle))"""

SES = """sum(CASE WHEN {r} = 1 THEN power(1 - {a}, {n} - 1) * {x} ELSE {a} * power(1 - {a}, {n} - {r}) * {x} END)"""


@query("ets_fixed_alpha", sql(f"""
WITH p AS (SELECT t.serie, t.cycle, t.origin, CAST(t.items AS DOUBLE) AS actual, {SES.format(r='h.r', a=0.2, n='(t.r - 1)', x='h.items')} AS predicted
FROM targets t JOIN ranked h ON h.serie = t.serie AND h.r < t.r GROUP BY ALL)
SELECT 'ets:0.2' AS candidate, serie, cycle, origin, actual, round(predicted, 6) AS predicted, round(abs(actual - predicted), 6) AS abs_error FROM p""", "panel", INDEX, RANKED))
def ets_fixed(p):
    return folds.ses_backtest(p, 0.2)


CROSTON = f"""
h AS (SELECT t.serie, t.cycle, t.origin, t.items AS actual, t.r - 1 AS n, h.r, h.items AS x FROM targets t JOIN ranked h ON h.serie = t.serie AND h.r < t.r),
nz AS (SELECT *, row_number() OVER w AS k, r - coalesce(lag(r) OVER w, 0) AS gap, count(*) OVER (PARTITION BY serie, cycle) AS m FROM h WHERE x > 0 WINDOW w AS (PARTITION BY serie, cycle ORDER BY r)),
sized AS (SELECT serie, cycle, {SES.format(r='k', a=0.1, n='m', x='x')} AS size, {SES.format(r='k', a=0.1, n='m', x='gap')} AS gap FROM nz GROUP BY ALL)"""


@query("croston", sql("""
WITH t AS (SELECT DISTINCT serie, cycle, origin, CAST(actual AS DOUBLE) AS actual FROM h WHERE n >= 3),
p AS (SELECT t.*, coalesce(0.95 * size / gap, 0.0) AS predicted FROM t LEFT JOIN sized USING (serie, cycle))
SELECT 'croston:sba' AS candidate, serie, cycle, origin, actual, round(predicted, 6) AS predicted, round(abs(actual - predicted), 6) AS abs_error FROM p""", "panel", INDEX, RANKED, CROSTON))
def croston(p):
    return folds.croston_backtest(p, "sba")


@query("croston_tsb", sql("""
WITH bought AS (SELECT serie, cycle, r AS rr, row_number() OVER (PARTITION BY serie, cycle ORDER BY r) AS k FROM h WHERE x > 0),
starts AS (SELECT serie, cycle, rr AS f FROM bought WHERE k = 1),
probs AS (SELECT h.serie, h.cycle, sum(CASE WHEN h.r = f THEN power(0.9, n - f) / f ELSE 0.1 * power(0.9, n - h.r) * CASE WHEN h.x > 0 THEN 1 ELSE 0 END END) AS prob FROM h JOIN starts USING (serie, cycle) WHERE h.r >= f GROUP BY ALL),
t AS (SELECT DISTINCT serie, cycle, origin, CAST(actual AS DOUBLE) AS actual FROM h WHERE n >= 3),
p AS (SELECT t.*, coalesce(prob * size, 0.0) AS predicted FROM t LEFT JOIN sized USING (serie, cycle) LEFT JOIN probs USING (serie, cycle))
SELECT 'croston:tsb' AS candidate, serie, cycle, origin, actual, round(predicted, 6) AS predicted, round(abs(actual - predicted), 6) AS abs_error FROM p""", "panel", INDEX, RANKED, CROSTON))
def croston_tsb(p):
    return folds.croston_backtest(p, "tsb")


TRAIN = "train AS (SELECT p.*, o.origin FROM panel p JOIN idx USING (cycle) JOIN origins o ON idx.i < o.origin)"
EXPONENT = """
logs AS (SELECT origin, serie, ln(CAST(cycle_days AS DOUBLE)) AS x, ln(CAST(items AS DOUBLE)) AS y FROM train WHERE items > 0),
slopes AS (SELECT origin, serie, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy FROM logs GROUP BY ALL),
exponents AS (SELECT origin, greatest(0.0, least(1.0, CASE WHEN sum(sxx) > 1e-9 THEN sum(sxy) / sum(sxx) ELSE 0.0 END)) AS exponent FROM slopes GROUP BY origin)"""


@query("days_exponent", sql("SELECT origin, round(exponent, 6) AS exponent FROM exponents", "panel", INDEX, TRAIN, EXPONENT))
def exponent(p):
    return folds.days_exponent(folds.training(p), ["origin"])


@query("window_scaled_backtest", sql("""
WITH exponents AS (SELECT origin, round(exponent, 6) AS exponent FROM raw_exponents),
levels AS (SELECT origin, serie, avg(items / power(CAST(cycle_days AS DOUBLE), exponent)) AS level FROM train JOIN exponents USING (origin) GROUP BY ALL),
p AS (SELECT t.serie, t.cycle, o.origin, CAST(t.items AS DOUBLE) AS actual, level * power(CAST(t.cycle_days AS DOUBLE), exponent) AS predicted
  FROM panel t JOIN origins o USING (cycle) JOIN levels l ON l.origin = o.origin AND l.serie = t.serie JOIN exponents e ON e.origin = o.origin)
SELECT 'naive:mean scaled' AS candidate, serie, cycle, origin, actual, round(predicted, 7) AS predicted, round(abs(actual - predicted), 7) AS abs_error FROM p""", "panel", INDEX, TRAIN, EXPONENT.replace("exponents AS", "raw_exponents AS")), 7)
def scaled(p):
    return folds.window_scaled_mean(p)


PASSES = ",\n".join(
    [f"r{i}a AS (SELECT serie, cycle, day, r - avg(r) OVER (PARTITION BY serie) AS r FROM r{i}), r{i + 1} AS (SELECT serie, cycle, day, r - avg(r) OVER (PARTITION BY cycle) AS r FROM r{i}a)" for i in range(10)]
)


@query("opening_factors", sql("SELECT CAST(day AS BIGINT) AS opening_day, round(exp(sum(r) / (count(*) + 100)), 6) AS factor FROM r10 GROUP BY day", "panel", "r0 AS (SELECT serie, cycle, window_start - opening_date AS day, ln(CAST(items AS DOUBLE)) AS r FROM panel WHERE items > 0)", PASSES))
def factors(p):
    return folds.opening_factors(p)


ETS_GRID = ([0.1, 0.3, 0.6], [0.0, 0.5, 1.0])


@query("ets_pooled", sql("""
WITH g AS (SELECT * FROM (VALUES (0.1), (0.3), (0.6)) a(alpha), (VALUES (0.0), (0.5), (1.0)) e(exponent)),
x AS (SELECT serie, r, items / power(CAST(cycle_days AS DOUBLE), CAST(exponent AS DOUBLE)) AS x, power(CAST(cycle_days AS DOUBLE), CAST(exponent AS DOUBLE)) AS scale, CAST(alpha AS DOUBLE) AS alpha, CAST(exponent AS DOUBLE) AS exponent FROM ranked, g),
l AS (SELECT t.serie, t.alpha, t.exponent, t.r, t.x, t.scale, sum(CASE WHEN h.r = 1 THEN power(1 - t.alpha, t.r - 2) * h.x ELSE t.alpha * power(1 - t.alpha, t.r - 1 - h.r) * h.x END) AS level
  FROM x t JOIN x h ON h.serie = t.serie AND h.alpha = t.alpha AND h.exponent = t.exponent AND h.r < t.r GROUP BY ALL),
e AS (SELECT alpha, exponent, sum(abs(x - level) * scale) AS error FROM l GROUP BY ALL)
SELECT alpha, exponent, round(error, 4) AS error FROM e ORDER BY round(error, 6), alpha, exponent LIMIT 1""", "panel", "ranked AS (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY opening_date) AS r FROM panel)"))
def pooled(p):
    return rounded(folds.pooled_ets_choice(folds.pooled_ets(p, *ETS_GRID)), 4)


def _candidates(p: DataFrame) -> DataFrame:
    """Several candidates' points; the panel's shuffle and sort are shared by the window forecasts."""
    picks = [("naive:last", folds.last_value()), ("naive:mean", folds.mean()), ("naive:seasonal17", folds.seasonal(17)), ("moving_average:5", folds.moving_average(5))]
    wide = p.select("*", *(c.alias(n) for n, c in picks)).join(F.broadcast(folds.origins(p)), "cycle")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), folds.floored(F.col(f"`{n}`")).alias("predicted"), F.col(f"`{n}`").isNotNull().alias("known")) for n, _ in picks)))
    rows = wide.select("serie", "cycle", "origin", F.col("items").cast("double").alias("actual"), pairs.alias("x")).where("x.known")
    return rows.select("x.candidate", "serie", "cycle", "origin", "actual", "x.predicted", F.abs(F.col("actual") - F.col("x.predicted")).alias("abs_error"))


CANDIDATES = f"""
wide AS (SELECT serie, cycle, CAST(items AS DOUBLE) AS actual, lag(items, 1) {W}) AS a, avg(items) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, lag(items, 17) {W}) AS c,
  avg(items) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS d FROM panel),
points AS (SELECT candidate, serie, cycle, origin, actual, CAST(predicted AS DOUBLE) AS predicted, abs(actual - predicted) AS abs_error FROM wide JOIN origins USING (cycle),
  LATERAL (VALUES ('naive:last', a), ('naive:mean', b), ('naive:seasonal17', c), ('moving_average:5', d)) v(candidate, predicted) WHERE predicted IS NOT NULL),
common AS (SELECT * FROM points SEMI JOIN (SELECT serie, cycle, origin FROM points GROUP BY ALL HAVING count(DISTINCT candidate) = 4) k USING (serie, cycle, origin))"""
METRICS = """count(*) AS n, round(avg(abs(predicted - actual)), 6) AS point_mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse, round(avg(predicted - actual), 6) AS bias,
  round(100 * sum(predicted - actual) / nullif(sum(actual), 0), 6) AS bias_pct, round(sum(abs(predicted - actual)) / nullif(sum(actual), 0), 6) AS wmape, round(quantile_cont(abs_error, 0.9), 6) AS p90"""


def points_query(name: str, body: str):
    return query(name, sql(body, "panel", INDEX, CANDIDATES))


@points_query("metrics_summary", f"SELECT candidate, {METRICS} FROM points GROUP BY candidate")
def summary(p):
    return _candidates(p).groupBy("candidate").agg(*evaluate.metrics())


@points_query("equal_weight_mae", "WITH s AS (SELECT candidate, serie, avg(abs_error) AS e FROM points GROUP BY ALL) SELECT candidate, round(avg(e), 6) AS mae, count(*) AS series FROM s GROUP BY candidate")
def equal_weight(p):
    return evaluate.equal_weight_mae(_candidates(p))


@points_query("worst_origin", "WITH s AS (SELECT candidate, origin, avg(abs_error) AS mae FROM points GROUP BY ALL) SELECT candidate, arg_max(origin, mae) AS origin, round(max(mae), 6) AS mae FROM s GROUP BY candidate")
def worst(p):
    return evaluate.worst_origin(_candidates(p))


@points_query("p90_abs_error", "SELECT candidate, origin, round(quantile_cont(abs_error, 0.9), 6) AS p90 FROM points GROUP BY ALL")
def p90(p):
    return _candidates(p).groupBy("candidate", "origin").agg(F.percentile("abs_error", F.lit(0.9)).alias("p90"))


@points_query("common_points_intersect", "SELECT candidate, serie, cycle, origin, actual, round(predicted, 6) AS predicted, round(abs_error, 6) AS abs_error FROM common")
def common(p):
    return evaluate.common_points(_candidates(p))


@points_query("compare_candidates", f"""
WITH s AS (SELECT candidate, serie, avg(abs_error) AS e FROM common GROUP BY ALL), m AS (SELECT candidate, round(avg(e), 6) AS mae, count(*) AS series FROM s GROUP BY candidate),
o AS (SELECT candidate, count(*) AS own_points FROM points GROUP BY candidate), c AS (SELECT candidate, {METRICS} FROM common GROUP BY candidate)
SELECT * FROM m JOIN c USING (candidate) JOIN o USING (candidate)""")
def compare(p):
    return evaluate.compare(_candidates(p))


@points_query("volume_bands", """
WITH s AS (SELECT serie, avg(actual) AS size FROM points GROUP BY serie), q AS (SELECT quantile_cont(size, 0.33) AS a, quantile_cont(size, 0.66) AS b FROM s),
n AS (SELECT serie, CASE WHEN size <= a THEN 'low' WHEN size <= b THEN 'mid' ELSE 'high' END AS band FROM s, q)
SELECT candidate, band, count(*) AS n, round(avg(abs_error), 6) AS mae, round(avg(CASE WHEN predicted < actual THEN 1.0 ELSE 0.0 END), 6) AS frac_under FROM points JOIN n USING (serie) GROUP BY ALL""")
def bands(p):
    return evaluate.volume_bands(_candidates(p))


@points_query("log_sigma_band", """
WITH t AS (SELECT candidate, cycle, sum(actual) AS a, sum(predicted) AS p FROM points GROUP BY ALL),
s AS (SELECT candidate, stddev_samp(ln(a / p)) AS s FROM t WHERE a > 0 AND p > 0 GROUP BY candidate)
SELECT candidate, CAST(h AS BIGINT) AS horizon, round(s, 6) AS sigma, round(exp(-1.96 * s * sqrt(h)), 6) AS low, round(exp(1.96 * s * sqrt(h)), 6) AS high FROM s, (SELECT unnest([1, 2, 3]) AS h)""")
def sigma(p):
    return evaluate.log_sigma(_candidates(p))


@query("naive_scale_mase", sql("""
WITH d AS (SELECT origin, abs(items - lag(items) OVER (PARTITION BY origin, serie ORDER BY opening_date)) AS c FROM train),
s AS (SELECT origin, avg(c) AS scale FROM d GROUP BY origin), m AS (SELECT candidate, origin, avg(abs_error) AS mae FROM common GROUP BY ALL)
SELECT candidate, round(avg(mae / scale), 6) AS mase FROM m JOIN s USING (origin) GROUP BY candidate""", "panel", INDEX, TRAIN, CANDIDATES))
def mase(p):
    return evaluate.mase(evaluate.common_points(_candidates(p).checkpoint()), evaluate.naive_scale(folds.training(p)))


@points_query("errors_by_state", f"SELECT candidate, state, {METRICS} FROM points JOIN (SELECT DISTINCT serie, state FROM panel) USING (serie) GROUP BY ALL")
def by_state(p):
    return evaluate.by_dimension(_candidates(p).join(p.select("serie", "state").distinct(), "serie"), "state")
