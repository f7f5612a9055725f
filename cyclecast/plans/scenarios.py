"""Queries on scenario windows, combined forecasts and their replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import calendar, panel, scenarios
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LAST, HISTORY = 3, 10


def query(name: str, oracle: str | None = None):
    """Registers a function of the order base summed by day and the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.order_days(spark, sf_dir), tables.item_panel(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


def questions(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel before its last cycle, and that cycle's series for windows moved and made longer."""
    last = F.broadcast(p.agg(F.max("opening_date").alias("_last")))
    split = p.crossJoin(last)
    rows = split.where("opening_date = _last").select("serie", "cycle", "opening_date", "window_start", "cycle_days")
    moved = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(n).alias("n")) for d, n in ((0, 0), (2, 0), (0, 7)))))
    rows = rows.withColumn("m", moved).select("serie", "cycle", "opening_date", F.date_add("window_start", F.col("m.d")).alias("window_start"), (F.col("cycle_days") + F.col("m.n")).alias("cycle_days"))
    return split.where("opening_date < _last").drop("_last"), rows


ASKED = """
lastday AS (SELECT max(opening_date) AS o FROM panel),
hist AS (SELECT * FROM panel WHERE opening_date < (SELECT o FROM lastday)),
asked AS (SELECT serie, cycle, opening_date, window_start + d AS window_start, cycle_days + n AS cycle_days FROM panel, (VALUES (0, 0), (2, 0), (0, 7)) m(d, n) WHERE opening_date = (SELECT o FROM lastday)),
expo AS (SELECT greatest(0.0, least(1.0, CASE WHEN sum(sxx) > 1e-9 THEN sum(sxy) / sum(sxx) ELSE 0.0 END)) AS e FROM (
  SELECT serie, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy FROM (SELECT serie, ln(CAST(cycle_days AS DOUBLE)) AS x, ln(CAST(items AS DOUBLE)) AS y FROM hist WHERE items > 0) GROUP BY serie)),
answers AS (
  SELECT 'naive:mean' AS candidate, serie, avg(items) AS v FROM hist GROUP BY serie UNION ALL
  SELECT 'naive:last', serie, arg_max(items, opening_date) FROM hist GROUP BY serie UNION ALL
  SELECT 'moving_average', serie, avg(items) FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY opening_date DESC) AS b FROM hist) WHERE b <= 5 GROUP BY serie UNION ALL
  SELECT 'window_scaled', serie, avg(items / power(CAST(cycle_days AS DOUBLE), e)) FROM hist, expo GROUP BY serie)"""


@query("scenario_forecast", sql("""
SELECT c.candidate, a.serie, a.cycle, a.window_start, CAST(a.cycle_days AS BIGINT) AS cycle_days, round(CASE WHEN c.candidate = 'window_scaled' THEN v * power(CAST(a.cycle_days AS DOUBLE), (SELECT e FROM expo)) ELSE v END, 4) AS predicted
FROM asked a CROSS JOIN (SELECT DISTINCT candidate FROM answers) c LEFT JOIN answers v ON v.candidate = c.candidate AND v.serie = a.serie""", "panel", ASKED))
def scenario_forecast(base, p):
    """All levels' answers."""
    return rounded(scenarios.answer(*questions(p)), 4)


@query("align_predictions", sql("""
SELECT a.serie, a.cycle, a.window_start, CAST(a.cycle_days AS BIGINT) AS cycle_days, round(m.v, 6) AS predicted
FROM asked a LEFT JOIN (SELECT serie, v FROM answers WHERE candidate = 'naive:mean' AND serie LIKE '%BUILDING%') m ON m.serie = a.serie""", "panel", ASKED))
def align(base, p):
    """Answers of some series alone, each told twice, in the order of the questions."""
    history, asked = questions(p)
    told = scenarios.answer(history, asked).where("candidate = 'naive:mean' and serie like '%BUILDING%'")
    return scenarios.attach(asked.select(*scenarios.WINDOW), told.unionByName(told))


@query("future_targets", sql("""
WITH w AS (SELECT * FROM (VALUES ('200217', '200117'), ('200203', '200103')) v(cycle, before)),
k AS (SELECT sector, cycle AS before, min(window_start) AS s, min(cycle_days) AS d FROM panel GROUP BY ALL),
o AS (SELECT cycle AS before, min(opening_date) + 364 AS o FROM panel GROUP BY cycle), m AS (SELECT before, median(d) AS m FROM k GROUP BY before)
SELECT x.sector, w.cycle, o.o AS opening_date, coalesce(k.s + 364, o.o) AS window_start, round(coalesce(CAST(k.d AS DOUBLE), m.m), 6) AS cycle_days
FROM w JOIN o USING (before) JOIN m USING (before) CROSS JOIN (SELECT DISTINCT sector FROM panel) x LEFT JOIN k ON k.sector = x.sector AND k.before = w.before""", "panel"))
def future(base, p):
    return scenarios.future_targets(p, ["200217", "200203"])


PATHS = f"""
targets AS (SELECT cycle AS path, opening_date AS o, opening_date - 1 AS as_of, (SELECT max(order_date) FROM base WHERE order_date < c.opening_date - 1) AS m
  FROM calendar c WHERE is_complete ORDER BY opening_date DESC, cycle DESC LIMIT {LAST}),
hist AS (SELECT path, cycle, opening_date FROM (SELECT t.path, c.cycle, c.opening_date, row_number() OVER (PARTITION BY t.path ORDER BY c.opening_date DESC, c.cycle DESC) AS r
  FROM targets t JOIN calendar c ON c.is_complete AND c.closing_date < t.as_of AND c.closing_date <= t.m) WHERE r <= {HISTORY}),
ahead AS (SELECT t.path, c.cycle FROM targets t JOIN (SELECT path, max(opening_date) AS l FROM hist GROUP BY path) h ON h.path = t.path JOIN calendar c ON c.opening_date > l AND c.opening_date <= t.o),
rec AS (SELECT a.path, b.sector, b.cycle, min(b.opening_date) AS ws, max(b.closing_date) AS we FROM ahead a JOIN base b ON b.cycle = a.cycle GROUP BY ALL),
whole AS (SELECT path, sector FROM (SELECT path, sector, count(*) AS k FROM rec GROUP BY ALL) JOIN (SELECT path, count(*) AS n FROM ahead GROUP BY ALL) USING (path) WHERE k = n),
known AS (SELECT DISTINCT t.path, p.serie, p.sector, p.state, p.city FROM targets t JOIN panel p ON p.closing_date < t.as_of),
emitted AS (SELECT r.path, r.sector, r.cycle, ws, we FROM rec r JOIN whole USING (path, sector) WHERE r.cycle = r.path AND (r.path, r.sector) IN (SELECT (path, sector) FROM known))"""

DAILY = """
levels AS (SELECT h.path, p.serie, avg(p.items) AS v FROM hist h JOIN panel p ON p.cycle = h.cycle GROUP BY ALL),
bs AS (SELECT h.path, d.sector, d.cycle, d."offset" * 10 // d.cycle_days AS bin, sum(d.actual / d.total_actual) AS share FROM days d JOIN hist h ON h.cycle = d.cycle WHERE d.total_actual > 0 GROUP BY ALL),
sc AS (SELECT path, sector, count(DISTINCT cycle) AS n FROM bs GROUP BY ALL),
bshare AS (SELECT bs.path, bs.sector, bin, sum(share) / any_value(n) AS share FROM bs JOIN sc ON sc.path = bs.path AND sc.sector = bs.sector GROUP BY ALL),
grid AS (SELECT e.*, CAST(u.i AS INTEGER) AS off, we - ws + 1 AS n_days, u.i * 10 // (we - ws + 1) AS bin FROM emitted e, LATERAL (SELECT unnest(range(0, we - ws + 1)) AS i) u),
w AS (SELECT g.*, coalesce(b.share, 0.0) / count(*) OVER (PARTITION BY g.path, g.sector, g.bin) AS w FROM grid g LEFT JOIN bshare b ON b.path = g.path AND b.sector = g.sector AND b.bin = g.bin),
shp AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY path, sector) > 0 THEN w / sum(w) OVER (PARTITION BY path, sector) ELSE 1.0 / n_days END AS sp FROM w),
daily AS (SELECT s.path, s.sector, k.state, k.city, s.cycle, s.ws + s.off AS date, s.off + 1 AS relative_day, l.v * s.sp AS items_pred
  FROM shp s JOIN known k ON k.path = s.path AND k.sector = s.sector LEFT JOIN levels l ON l.path = k.path AND l.serie = k.serie)"""

REPLAY = """
act AS (SELECT e.path, b.sector, b.state, b.city, b.order_date AS date, CAST(sum(b.items) AS DOUBLE) AS actual FROM base b JOIN emitted e ON e.sector = b.sector AND e.cycle = b.cycle GROUP BY ALL),
rows_ AS (SELECT coalesce(d.path, a.path) AS target_cycle, coalesce(d.sector, a.sector) AS sector, coalesce(d.state, a.state) AS state, coalesce(d.city, a.city) AS city, items_pred, coalesce(actual, 0.0) AS actual, items_pred - coalesce(actual, 0.0) AS e
  FROM daily d FULL JOIN act a ON a.path = d.path AND a.sector = d.sector AND a.state = d.state AND a.city = d.city AND a.date = d.date)"""
REPLAYED = """round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(sum(abs(e)) / nullif(sum(actual) FILTER (e IS NOT NULL), 0), 6) AS wmape, round(avg(e), 6) AS bias,
  round(100 * sum(e) / nullif(sum(actual) FILTER (e IS NOT NULL), 0), 6) AS bias_pct, count(e) AS n_scored_days, count(*) - count(e) AS n_unpredicted_rows,
  round(coalesce(sum(actual) FILTER (e IS NULL), 0.0), 6) AS unpredicted_actual_items, round(sum(actual) FILTER (e IS NOT NULL) / nullif(sum(actual), 0), 6) AS actual_volume_coverage"""


def _replayed(base: DataFrame, p: DataFrame) -> DataFrame:
    return scenarios.replay(base, p, panel.shape_days(base), LAST, HISTORY)


@query("replay_validation", sql(f"""
SELECT CASE WHEN grouping(target_cycle) = 1 THEN 'overall' ELSE 'cycle' END AS scope, coalesce(target_cycle, 'ALL') AS cycle, {REPLAYED} FROM rows_ GROUP BY ROLLUP (target_cycle)""", "panel", "days", PATHS, DAILY, REPLAY))
def replay_validation(base, p):
    return scenarios.summarize_replay(_replayed(base, p))


@query("replay_cities", sql(f"SELECT target_cycle, sector, state, city, {REPLAYED} FROM rows_ GROUP BY ALL", "panel", "days", PATHS, DAILY, REPLAY))
def replay_cities(base, p):
    return scenarios.summarize_cities(_replayed(base, p))


@query("combined_scenarios", sql("""
SELECT s.scenario AS path, d.sector, d.state, d.city, d.cycle, d.date + s.shift AS date, CAST(d.relative_day AS BIGINT) AS relative_day, round(d.items_pred, 6) AS items_pred
FROM daily d, (VALUES ('recorded', 0), ('later', 3)) s(scenario, shift) WHERE d.path = (SELECT max(path) FROM targets)""", "panel", "days", PATHS, DAILY))
def combined_scenarios(base, p):
    """The last cycle as it was recorded and opened three days later, told the day before it opens."""
    cycles = calendar.cycle_calendar(base)
    last = scenarios.replay_paths(base, cycles, LAST).orderBy(F.desc("path")).limit(1)
    windows = scenarios.recorded_windows(base, cycles, last, scenarios.closed_history(cycles, last, HISTORY))
    moved = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in (("recorded", 0), ("later", 3)))))
    paths = last.withColumn("m", moved).select(F.col("m.n").alias("path"), "as_of", "last_order")
    windows = windows.withColumn("m", moved).select(F.col("m.n").alias("path"), "sector", "cycle", F.date_add("window_start", F.col("m.d")).alias("window_start"), F.date_add("window_end", F.col("m.d")).alias("window_end"), "emit")
    return scenarios.combined(p, panel.shape_days(base), cycles, paths, windows, HISTORY).drop("uniform_fallback")
