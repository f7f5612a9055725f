"""Queries on the back-tests of the whole hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import hierarchy, nodefolds
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.shapes import NODES
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def known_nodes(p: DataFrame) -> DataFrame:
    """The panel's nodes with their children, parents and closed states."""
    nodes = hierarchy.node_totals(p).checkpoint()  # read for children and parents, too
    return nodefolds.with_closed_state(hierarchy.with_parent(hierarchy.with_children(nodes))).checkpoint()


def query(name: str, oracle: str | None = None):
    """Registers a function of the panel's nodes."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(known_nodes(tables.item_panel(spark, sf_dir))), 7)
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


FOLDS = """
cyc AS (SELECT cycle, min(opening_date) AS o, max(closing_date) AS c, row_number() OVER (ORDER BY min(opening_date), cycle) AS idx FROM nodes GROUP BY cycle),
open_from AS (SELECT a.cycle, a.idx, min(b.idx) - 1 AS closed FROM cyc a JOIN cyc b ON b.c >= a.o GROUP BY ALL),
t AS (SELECT tree.* REPLACE (CAST(items AS DOUBLE) AS items, CAST(parent_actual AS DOUBLE) AS parent_actual), idx, closed, row_number() OVER (PARTITION BY node ORDER BY idx) AS r FROM tree JOIN open_from USING (cycle)),
asked AS (SELECT * FROM t WHERE closed >= 20),
before AS (SELECT a.cycle, a.node, a.parent, a.level, b.items, b.parent_actual, row_number() OVER (PARTITION BY a.cycle, a.node ORDER BY b.idx DESC) AS back FROM asked a JOIN t b ON b.node = a.node AND b.idx <= a.closed),
state AS (SELECT cycle, node, parent, level, avg(CASE WHEN back <= 5 THEN items END) AS m5, sum(CASE WHEN back <= 5 THEN items END) AS a, sum(CASE WHEN back <= 5 THEN parent_actual END) AS p, sum(items) AS c, sum(parent_actual) AS d, count(CASE WHEN back <= 5 THEN 1 END) AS n FROM before GROUP BY ALL),
scores AS (SELECT cycle, node, parent, level, greatest(coalesce(a / nullif(p, 0) * (n / (n + 5.0)) + c / nullif(d, 0) * (1 - n / (n + 5.0)), c / nullif(d, 0), 0.0), 0.0) AS s FROM state WHERE parent <> ''),
shares AS (SELECT cycle, node, parent, level, CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END AS share FROM scores WINDOW w AS (PARTITION BY cycle, parent)),
grid AS (SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(exponent AS DOUBLE) AS exponent FROM (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) a(alpha), (VALUES (0.0), (0.5), (1.0)) e(exponent)),
units AS (SELECT node, idx, r, alpha, exponent, power(CAST(cycle_days AS DOUBLE), exponent) AS scale, items / power(CAST(cycle_days AS DOUBLE), exponent) AS x FROM t, grid WHERE level = 'region'),
levels AS (SELECT k.node, k.idx, k.r, k.alpha, k.exponent, k.x, k.scale, sum(CASE WHEN j.r = 1 THEN power(1 - k.alpha, k.r - 1) * j.x ELSE k.alpha * power(1 - k.alpha, k.r - j.r) * j.x END) AS level
  FROM units k JOIN units j ON j.node = k.node AND j.alpha = k.alpha AND j.exponent = k.exponent AND j.r <= k.r GROUP BY ALL),
errors AS (SELECT *, sum(abs(x - before) * scale) OVER (PARTITION BY node, alpha, exponent ORDER BY r) AS error FROM (SELECT *, lag(level) OVER (PARTITION BY node, alpha, exponent ORDER BY r) AS before FROM levels)),
upto AS (SELECT a.cycle, e.node, e.alpha, e.exponent, arg_max(e.level, e.r) AS level, coalesce(arg_max(e.error, e.r), 0.0) AS error FROM errors e JOIN (SELECT DISTINCT cycle, closed FROM asked WHERE level = 'region') a ON e.idx <= a.closed GROUP BY ALL),
best AS (SELECT cycle, alpha, exponent FROM (SELECT cycle, alpha, exponent, row_number() OVER (PARTITION BY cycle ORDER BY round(sum(error), 6), alpha, exponent) AS k FROM upto GROUP BY cycle, alpha, exponent) WHERE k = 1),
roots AS (
  SELECT 'topdown_ma_5' AS candidate, cycle, node, m5 AS value FROM state WHERE level = 'region' UNION ALL
  SELECT 'topdown_ets', a.cycle, a.node, greatest(u.level * power(CAST(a.cycle_days AS DOUBLE), u.exponent), 0.0) FROM asked a JOIN upto u USING (cycle, node) JOIN best USING (cycle, alpha, exponent)),
down1 AS (SELECT candidate, s.cycle, s.node, value * share AS value FROM shares s JOIN roots v ON v.cycle = s.cycle AND v.node = s.parent WHERE s.level = 'management'),
down2 AS (SELECT candidate, s.cycle, s.node, value * share AS value FROM shares s JOIN down1 v ON v.cycle = s.cycle AND v.node = s.parent WHERE s.level = 'sector'),
down3 AS (SELECT candidate, s.cycle, s.node, value * share AS value FROM shares s JOIN down2 v ON v.cycle = s.cycle AND v.node = s.parent WHERE s.level = 'city'),
told AS (SELECT 'direct_ma_5' AS candidate, cycle, node, m5 AS value FROM state UNION ALL SELECT * FROM roots UNION ALL SELECT * FROM down1 UNION ALL SELECT * FROM down2 UNION ALL SELECT * FROM down3),
points AS (SELECT candidate, cycle, node, a.level, a.items AS actual, coalesce(value, 0.0) AS predicted, value IS NOT NULL AS has FROM asked a CROSS JOIN (SELECT DISTINCT candidate FROM told) LEFT JOIN told USING (candidate, cycle, node))"""


def _summary(*by: str) -> str:
    keys = ", ".join(["scope", "candidate", "level", *by])
    return f"""
WITH scoped AS (SELECT 'all' AS scope, * FROM points UNION ALL SELECT 'active', * FROM points WHERE level <> 'city' OR actual > 0),
n AS (SELECT {keys}, node, avg(abs(predicted - actual)) AS own, sum(abs(predicted - actual)) AS ab, sum(predicted - actual) AS miss, sum(actual) AS actual, count(*) AS n, count(*) FILTER (has) AS told, coalesce(sum(actual) FILTER (has), 0) AS told_actual FROM scoped GROUP BY ALL)
SELECT {keys}, round(avg(own), 7) AS mae, round(sum(ab) / sum(n), 7) AS mae_pooled, round(100 * sum(ab) / nullif(sum(actual), 0), 7) AS wmape_pct, round(sum(miss) / sum(n), 7) AS bias,
  round(100 * sum(miss) / nullif(sum(actual), 0), 7) AS bias_pct, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_nodes, CAST(sum(n) - sum(told) AS BIGINT) AS n_missing,
  round(100 * sum(told) / sum(n), 7) AS coverage_points_pct, round(100 * sum(told_actual) / nullif(sum(actual), 0), 7) AS coverage_volume_pct
FROM n GROUP BY {keys}"""


@query("hierarchy_backtest", sql(_summary(), "panel", NODES, FOLDS))
def overall(known):
    return nodefolds.summary(nodefolds.scored(known, nodefolds.forecasts(known)))


@query("hierarchy_backtest_cycles", sql(_summary("cycle"), "panel", NODES, FOLDS))
def by_cycle(known):
    return nodefolds.summary(nodefolds.scored(known, nodefolds.forecasts(known)), "cycle")


@query("hierarchy_backtest_points", sql("SELECT candidate, cycle, node, level, round(actual, 7) AS actual, round(predicted, 7) AS predicted, has AS has_prediction, level <> 'city' OR actual > 0 AS active FROM points WHERE level <> 'city'", "panel", NODES, FOLDS))
def upper_points(known):
    """Points above the cities."""
    return nodefolds.scored(known, nodefolds.forecasts(known)).where("level <> 'city'")


@query("closed_state", sql("""
SELECT a.node, a.cycle, a.idx, a.closed, count(b.r) AS n_history, round(arg_max(b.items, b.r), 7) AS last_items, round(avg(b.items) FILTER (b.r > x.m - 5), 7) AS mean_5
FROM t a LEFT JOIN (SELECT a.node, a.cycle, max(b.r) AS m FROM t a JOIN t b ON b.node = a.node AND b.idx <= a.closed GROUP BY ALL) x ON x.node = a.node AND x.cycle = a.cycle
  LEFT JOIN t b ON b.node = a.node AND b.idx <= a.closed GROUP BY ALL""", "panel", NODES, FOLDS))
def closed_state(known):
    """What was known of each node when its cycle opened."""
    return known.select("node", "cycle", "idx", "closed", F.coalesce("state.n_history", F.lit(0)).cast("long").alias("n_history"), F.col("state.lag_1").alias("last_items"), "state.mean_5")


@query("hierarchy_learned_shares")
def learned_shares(known):
    """Of the last cycle."""
    cycle = known.agg(F.max_by("cycle", "idx")).first()[0]
    return nodefolds.learned_shares(known, cycle)


@query("hierarchy_learned_backtest")
def learned_backtest(known):
    """The last two origins, beside the candidates that aren't learnt."""
    found = nodefolds.learned_backtest(known, 2).unionByName(nodefolds.forecasts(known, last=2))
    return nodefolds.summary(nodefolds.scored(known, found, last=2))
