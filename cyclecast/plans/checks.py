"""Queries that count what is wrong with orders, planned windows, panels and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import calendar, checks, panel, scenarios
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.scenarios import DAILY, HISTORY, LAST, PATHS
from cyclecast.plans.sqlbase import sql
from cyclecast.sources.orders import orders_of_star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, of=tables.order_days):
    """Registers a function of the order base, summed by day unless lines are counted, and the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(of(spark, sf_dir), tables.item_panel(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


@query("order_checks", sql("""
WITH b AS (SELECT * REPLACE (CASE WHEN cd = 400 THEN order_date::TIMESTAMP + INTERVAL 6 HOUR WHEN cd <> 100 THEN order_date::TIMESTAMP END AS order_date,
  CASE WHEN cd = 300 THEN -CAST(items AS DOUBLE) WHEN cd = 500 THEN 'NaN'::DOUBLE ELSE CAST(items AS DOUBLE) END AS items, CASE WHEN cd = 200 THEN closing_date - 10 ELSE closing_date END AS closing_date) FROM base),
c AS (SELECT count(*) FILTER (order_date IS NULL) AS a, count(*) FILTER (date_trunc('day', order_date) <> order_date) AS b, count(*) FILTER (order_date IS NOT NULL AND NOT order_date BETWEEN opening_date AND closing_date) AS c, count(*) FILTER (isnan(items)) AS d, count(*) FILTER (items < 0) AS e FROM b)
SELECT v."check", CAST(v.violations AS BIGINT) AS violations FROM c, LATERAL (VALUES ('null_dates', a), ('not_midnight', b), ('outside_window', c), ('items_not_finite', d), ('items_negative', e)) v("check", violations)""", "base"), of=orders_of_star)
def order_checks(base, p):
    """Of a base with a fault for each check: CDs without dates, with times, cut windows, negative items and none."""
    day, items = F.col("order_date").cast("timestamp"), F.col("items").cast("double")
    faulty = base.withColumns({
        "order_date": F.when(F.col("cd") == 400, day + F.expr("interval 6 hours")).when(F.col("cd") != 100, day),
        "items": F.when(F.col("cd") == 300, -items).when(F.col("cd") == 500, float("nan")).otherwise(items),
        "closing_date": F.when(F.col("cd") == 200, F.date_sub("closing_date", 10)).otherwise(F.col("closing_date")),
    })
    return checks.orders(faulty)


PLANNED = """
wcal AS (SELECT cycle, opening_date FROM calendar WHERE is_complete ORDER BY opening_date DESC LIMIT 4),
rec AS (SELECT w.sector, w.cycle, c.opening_date, w.window_start, w.window_end FROM windows w JOIN wcal c USING (cycle)),
planned AS (
  SELECT 'recorded' AS scenario, sector, cycle, opening_date, window_start, window_end FROM rec UNION ALL
  SELECT 'early', sector, cycle, opening_date, window_start - 2, window_end FROM rec WHERE cycle <> (SELECT max(cycle) FROM wcal) OR sector LIKE '%1' UNION ALL
  SELECT 'early', sector, cycle, opening_date, window_start, window_end FROM rec WHERE sector LIKE '%7' UNION ALL
  SELECT ' ', sector, 'S' || cycle, opening_date, window_start, window_end FROM rec WHERE sector LIKE '%3'),
flagged AS (SELECT *, cycle = (SELECT max(cycle) FROM wcal) AS emit, (SELECT opening_date FROM wcal ORDER BY cycle DESC LIMIT 1) AS as_of FROM planned)"""


def planned(base: DataFrame) -> DataFrame:
    """Recorded windows of the last four cycles, an early scenario with faults, and one without a name."""
    cycles = calendar.cycle_calendar(base).where("is_complete").orderBy(F.desc("opening_date")).limit(4).select("cycle", "opening_date")
    recorded = calendar.sector_windows(base).join(cycles, "cycle").select("sector", "cycle", "opening_date", "window_start", "window_end")
    ends = F.broadcast(cycles.agg(F.max("cycle").alias("_last"), F.max_by("opening_date", "cycle").alias("as_of")))
    recorded = recorded.crossJoin(ends)
    early = recorded.where("cycle <> _last or sector like '%1'").withColumn("window_start", F.date_sub("window_start", 2)).unionByName(recorded.where("sector like '%7'"))
    nameless = recorded.where("sector like '%3'").withColumn("cycle", F.concat(F.lit("S"), "cycle"))
    found = recorded.withColumn("scenario", F.lit("recorded")).unionByName(early.withColumn("scenario", F.lit("early"))).unionByName(nameless.withColumn("scenario", F.lit(" ")))
    return found.withColumn("emit", F.col("cycle") == F.col("_last")).drop("_last")


@query("window_checks", sql("""
WITH r AS (SELECT scenario, sector, count(DISTINCT cycle) AS n FROM flagged GROUP BY ALL), a AS (SELECT scenario, count(DISTINCT cycle) AS m FROM flagged GROUP BY ALL)
SELECT 'empty_id' AS "check", count(*) FILTER (trim(scenario) = '') AS violations FROM flagged UNION ALL
SELECT 'cycle_code', count(*) FILTER (NOT regexp_full_match(cycle, '[0-9]{6}')) FROM flagged UNION ALL
SELECT 'days_in_order', count(*) FILTER (NOT (opening_date <= window_start AND window_start <= window_end)) FROM flagged UNION ALL
SELECT 'opens_before_as_of', count(*) FILTER (emit AND opening_date <= as_of) FROM flagged UNION ALL
SELECT 'repeated_window', count(*) FROM (SELECT 1 FROM flagged GROUP BY scenario, sector, cycle HAVING count(*) > 1) UNION ALL
SELECT 'several_openings', count(*) FROM (SELECT 1 FROM flagged GROUP BY scenario, cycle HAVING count(DISTINCT opening_date) > 1) UNION ALL
SELECT 'shared_opening', count(*) FROM (SELECT 1 FROM flagged GROUP BY scenario, opening_date HAVING count(DISTINCT cycle) > 1) UNION ALL
SELECT 'other_sectors', count(*) FILTER (n < m) FROM r JOIN a USING (scenario)""", "calendar", PLANNED))
def window_checks(base, p):
    return checks.windows(planned(base))


@query("missing_between", sql("""
WITH h AS (SELECT max(opening_date) AS l FROM calendar WHERE is_complete AND cycle < (SELECT min(cycle) FROM wcal)),
kept_ AS (SELECT * FROM flagged WHERE cycle <> (SELECT cycle FROM wcal ORDER BY cycle LIMIT 1 OFFSET 1)), e AS (SELECT scenario, max(opening_date) AS e FROM kept_ GROUP BY scenario)
SELECT scenario, c.cycle FROM calendar c, h, e WHERE c.opening_date > l AND c.opening_date <= e AND (scenario, c.cycle) NOT IN (SELECT (scenario, cycle) FROM kept_)""", "calendar", PLANNED))
def missing_between(base, p):
    """What the planned windows lack if one of the four cycles is left out."""
    cycles = calendar.cycle_calendar(base)
    rows = planned(base)
    four = cycles.where("is_complete").orderBy(F.desc("opening_date")).limit(4)
    second = four.orderBy("cycle").limit(2).agg(F.max("cycle").alias("_second"))
    some = rows.crossJoin(F.broadcast(second)).where("cycle <> _second").drop("_second")
    before = cycles.where("is_complete").crossJoin(F.broadcast(four.agg(F.min("cycle").alias("_first")))).where("cycle < _first")
    return checks.missing_between(cycles, before, some)


@query("reused_cycles", sql("SELECT DISTINCT cycle FROM flagged WHERE cycle IN (SELECT cycle FROM panel)", "panel", PLANNED))
def reused(base, p):
    return checks.reused(p, planned(base))


@query("hierarchy_checks", sql("""
WITH g AS (SELECT * FROM panel UNION ALL SELECT * FROM panel WHERE sector LIKE '%3'),
f AS (SELECT * REPLACE (CASE WHEN items > 400 THEN -items ELSE items END AS items, CASE WHEN city = 'BUILDING' THEN 'other' ELSE management END AS management, CASE WHEN city <> 'MACHINERY' THEN state END AS state, CASE WHEN sector LIKE '%5' THEN 0 ELSE cycle_days END AS cycle_days) FROM g)
SELECT 'nulls' AS "check", count(*) AS violations FROM f WHERE state IS NULL UNION ALL SELECT 'negative_items', count(*) FROM f WHERE items < 0 UNION ALL SELECT 'no_days', count(*) FROM f WHERE cycle_days < 1 UNION ALL
SELECT 'several_organizations', count(*) FROM (SELECT 1 FROM f GROUP BY sector HAVING count(DISTINCT (region, management)) > 1) UNION ALL SELECT 'repeated_rows', count(*) FROM (SELECT 1 FROM f GROUP BY serie, cycle HAVING count(*) > 1)""", "panel"))
def hierarchy_checks(base, p):
    """Of a panel with a fault for each check: a city without state, negative demand, sectors without days, a city
    under another management, sectors that are there twice."""
    twice = p.unionByName(p.where("sector like '%3'"))
    faulty = twice.withColumns({
        "items": F.when(F.col("items") > 400, -F.col("items")).otherwise(F.col("items")), "management": F.when(F.col("city") == "BUILDING", "other").otherwise(F.col("management")),
        "state": F.when(F.col("city") != "MACHINERY", F.col("state")), "cycle_days": F.when(F.col("sector").like("%5"), 0).otherwise(F.col("cycle_days")),
    })
    return checks.hierarchy(faulty)


@query("forecast_checks", sql("""
SELECT v."check", CAST(v.n AS BIGINT) AS violations FROM (VALUES ('bad_share', 0), ('repeated_day', 0), ('shares_dont_add_up', 0), ('bad_level', 0), ('repeated_level', 0), ('not_conserved', (SELECT count(*) FROM (SELECT DISTINCT path, sector, state, city FROM daily WHERE items_pred > 0 AND relative_day = 1)))) v("check", n)""", "panel", "days", PATHS, DAILY))
def forecast_checks(base, p):
    """Of replayed forecasts whose first days were lost."""
    cycles = calendar.cycle_calendar(base)
    paths = scenarios.replay_paths(base, cycles, LAST)
    history = scenarios.closed_history(cycles, paths, HISTORY)
    windows = scenarios.recorded_windows(base, cycles, paths, history).where("emit").drop("emit")
    levels = scenarios.path_levels(p, history, scenarios.level_queries(windows, scenarios.known_cities(p, paths)))
    levels = levels.checkpoint()
    shapes = scenarios.path_shapes(panel.shape_days(base), history, windows.join(levels.select("path", "sector").distinct(), ["path", "sector"], "left_semi")).checkpoint()
    daily = scenarios.combine(levels, shapes).where("relative_day > 1")
    return checks.forecast(levels, shapes, daily, scenarios.CITY)


@query("one_cd_each", sql("SELECT sector, count(DISTINCT cd) AS groups FROM base GROUP BY sector HAVING count(DISTINCT cd) <> 1", "base"))
def one_cd_each(base, p):
    return checks.one_each(base, "sector", "cd")
