"""Queries on curves scored from cycle to cycle, and on forecasts of the whole hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import curves, hierarchy, panel
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of the order base summed by day and the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.order_days(spark, sf_dir), tables.item_panel(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


def _strategy(number: int, name: str, bins: int, sliding: bool) -> str:
    frame = f"RANGE BETWEEN {'20' if sliding else 'UNBOUNDED'} PRECEDING AND 1 PRECEDING"
    n = str(number)
    return f"""
b{n} AS (SELECT sector, i, "offset" * {bins} // cycle_days AS bin, sum(CASE WHEN total_actual > 0 THEN actual / total_actual ELSE 0.0 END) AS s FROM placed GROUP BY ALL),
k{n} AS (SELECT sector, i, sum(p) OVER (PARTITION BY sector ORDER BY i {frame}) AS n FROM (SELECT sector, i, max(CASE WHEN total_actual > 0 THEN 1 ELSE 0 END) AS p FROM placed GROUP BY ALL)),
c{n} AS (SELECT x.sector, x.i, x.bin, x.s / nullif(k.n, 0) AS share FROM (SELECT sector, i, bin, sum(s) OVER (PARTITION BY sector, bin ORDER BY i {frame}) AS s FROM b{n}) x JOIN k{n} k ON k.sector = x.sector AND k.i = x.i),
w{n} AS (SELECT p.*, coalesce(c.share, 0.0) / count(*) OVER (PARTITION BY p.sector, p.i, c.bin) AS w FROM placed p JOIN c{n} c ON c.sector = p.sector AND c.i = p.i AND c.bin = p."offset" * {bins} // p.cycle_days WHERE p.i > 20),
t{n} AS (SELECT *, sum(w) OVER (PARTITION BY sector, i) AS t FROM w{n}),
p{n} AS (SELECT '{name}' AS candidate, i, sector, cycle, date, CASE WHEN t > 0 THEN w / t ELSE 1.0 / cycle_days END AS share_pred, t <= 0 AS flat, actual, total_actual FROM t{n})"""


SWEEP = ",".join(
    ["""
ordc AS (SELECT cycle, row_number() OVER (ORDER BY min(window_start), cycle) AS i FROM days GROUP BY cycle),
placed AS (SELECT d.*, o.i FROM days d JOIN ordc o ON o.cycle = d.cycle)"""]
    + [_strategy(i, name, bins, sliding) for i, (name, (bins, sliding)) in enumerate(curves.STRATEGIES.items())]
    + ["\nspoints AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(curves.STRATEGIES))) + ")"]
)


@query("compare_shapes", sql("""
WITH e AS (SELECT *, share_pred * total_actual - actual AS e, abs(share_pred - actual / nullif(total_actual, 0)) AS se FROM spoints),
c AS (SELECT candidate, i, sector, cycle, avg(se) AS m, sum(se) AS v, max(total_actual) <= 0 AS zero, bool_or(flat) AS flat, sum(abs(e)) AS ae, sum(e * e) AS ee, sum(e) AS e, sum(actual) AS a, count(*) AS d FROM e GROUP BY ALL),
f AS (SELECT candidate, 100 * avg(m) AS share_mae_pp, 0.5 * avg(v) AS total_variation, sum(ae) / sum(d) AS mae, sqrt(sum(ee) / sum(d)) AS rmse, sum(e) / sum(d) AS bias, sum(ae) / nullif(sum(a), 0) AS wmape, CAST(sum(d) AS BIGINT) AS n_days, count(*) AS n_sector_cycles,
  count(*) FILTER (zero) AS n_zero_total_cycles, count(*) FILTER (flat) AS n_uniform_fallback_cycles, count(DISTINCT i) AS n_origins FROM c GROUP BY candidate)
SELECT candidate, round(share_mae_pp, 6) AS share_mae_pp, round(total_variation, 6) AS total_variation, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(wmape, 6) AS wmape, n_days, n_sector_cycles, n_zero_total_cycles, n_uniform_fallback_cycles, n_origins,
  row_number() OVER (ORDER BY share_mae_pp NULLS LAST, candidate) AS place FROM f""", "days", SWEEP))
def compare_shapes(base, p):
    return curves.compare(curves.sweep(panel.shape_days(base).checkpoint()))


@query("learned_shape")
def learned_shape(base, p):
    """The last cycle's curves, learned from all before it."""
    days = panel.shape_days(base).checkpoint()
    last = F.broadcast(days.agg(F.max_by("cycle", F.struct("window_start", "cycle")).alias("cycle")))
    windows = days.join(last, "cycle", "left_semi").select("sector", "cycle", "window_start", "cycle_days").distinct()
    return curves.learned(days.join(last, "cycle", "left_anti"), windows)


def split(p: DataFrame, cycles: int) -> tuple[DataFrame, DataFrame]:
    """The panel without its last cycles, and these."""
    order = p.groupBy("cycle").agg(F.min("opening_date").alias("_d")).orderBy(F.desc("_d"), F.desc("cycle")).limit(cycles).select("cycle")
    last = F.broadcast(order)
    return p.join(last, "cycle", "left_anti"), p.join(last, "cycle", "left_semi")


ROOTS = """
lastc AS (SELECT cycle FROM panel GROUP BY cycle ORDER BY min(opening_date) DESC, cycle DESC LIMIT 1),
sect AS (SELECT region, management, sector, cycle, sum(items) AS items, min(opening_date) AS opening_date, any_value(cycle_days) AS days FROM panel GROUP BY ALL),
root AS (SELECT CAST(to_json([region]) AS VARCHAR) AS node, cycle, min(opening_date) AS od, CAST(sum(items) AS DOUBLE) AS items, avg(days) AS days, row_number() OVER (PARTITION BY region ORDER BY min(opening_date)) AS r FROM sect WHERE cycle NOT IN (SELECT cycle FROM lastc) GROUP BY region, cycle),
grd AS (SELECT CAST(a AS DOUBLE) AS alpha, CAST(e AS DOUBLE) AS expo FROM (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) x(a), (VALUES (0.0), (0.5), (1.0)) y(e)),
xs AS (SELECT node, r, items / power(days, expo) AS x, power(days, expo) AS scale, alpha, expo FROM root, grd),
lv AS (SELECT t.node, t.alpha, t.expo, t.r, any_value(t.x) AS x, any_value(t.scale) AS scale, sum(CASE WHEN h.r = 1 THEN power(1 - t.alpha, t.r - 2) * h.x ELSE t.alpha * power(1 - t.alpha, t.r - 1 - h.r) * h.x END) AS level FROM xs t JOIN xs h ON h.node = t.node AND h.alpha = t.alpha AND h.expo = t.expo AND h.r < t.r GROUP BY ALL),
ch AS (SELECT alpha, expo FROM lv GROUP BY ALL ORDER BY round(sum(abs(x - level) * scale), 6), alpha, expo LIMIT 1),
fin AS (SELECT h.node, sum(CASE WHEN h.r = 1 THEN power(1 - h.alpha, m.n - 1) * h.x ELSE h.alpha * power(1 - h.alpha, m.n - h.r) * h.x END) AS level FROM xs h JOIN ch ON ch.alpha = h.alpha AND ch.expo = h.expo JOIN (SELECT node, max(r) AS n FROM root GROUP BY node) m ON m.node = h.node GROUP BY h.node),
rq AS (SELECT CAST(to_json([region]) AS VARCHAR) AS node, avg(days) AS days FROM sect WHERE cycle IN (SELECT cycle FROM lastc) GROUP BY region)"""


@query("root_ets", sql("SELECT rq.node, round(coalesce(level * power(days, (SELECT expo FROM ch)), 0.0), 4) AS value FROM rq LEFT JOIN fin ON fin.node = rq.node", "panel", ROOTS))
def root_ets(base, p):
    """The regions' totals of the last cycle, from those before it."""
    history, last = split(p, 1)
    root = hierarchy.LEVELS[0]
    asked = hierarchy.node_totals(last).where(F.col("level") == root).select("node", "cycle_days")
    return rounded(hierarchy.root_forecast(hierarchy.node_totals(history).where(F.col("level") == root), asked), 4)


@query("sector_shares", sql("""
WITH r AS (SELECT cycle FROM panel GROUP BY cycle ORDER BY min(opening_date) DESC, cycle DESC LIMIT 5),
s AS (SELECT serie, region, management, state, city, sum(CASE WHEN cycle IN (SELECT cycle FROM r) THEN items ELSE 0 END) AS a, sum(items) AS b FROM panel GROUP BY ALL),
v AS (SELECT *, CASE WHEN sum(a) OVER g > 0 THEN a ELSE b END AS x FROM s WINDOW g AS (PARTITION BY region, management, state, city))
SELECT serie, round(CASE WHEN sum(x) OVER g > 0 THEN x / sum(x) OVER g ELSE 1.0 / count(*) OVER g END, 6) AS share FROM v WINDOW g AS (PARTITION BY region, management, state, city)""", "panel"))
def sector_shares(base, p):
    return hierarchy.sector_shares(p)


@query("latest_organization", sql("""
SELECT q.sector, q.cycle, arg_max(h.region, h.opening_date) AS region, arg_max(h.management, h.opening_date) AS management FROM (SELECT DISTINCT sector, cycle FROM panel WHERE cycle IN (SELECT cycle FROM lastc)) q
LEFT JOIN (SELECT * FROM panel WHERE cycle NOT IN (SELECT cycle FROM lastc)) h ON h.sector = q.sector GROUP BY ALL""", "panel", ROOTS))
def latest_organization(base, p):
    history, last = split(p, 1)
    return hierarchy.latest_organization(history, last.select("sector", "cycle").distinct())


@query("hierarchy_scores", sql("""
WITH n AS (SELECT level, node, cycle, sum(items) AS items FROM (
  SELECT 'region' AS level, CAST(to_json([region]) AS VARCHAR) AS node, cycle, items FROM panel UNION ALL SELECT 'management', CAST(to_json([region, management]) AS VARCHAR), cycle, items FROM panel UNION ALL
  SELECT 'sector', CAST(to_json([region, management, sector]) AS VARCHAR), cycle, items FROM panel UNION ALL SELECT 'city', CAST(to_json([region, management, sector, state, city]) AS VARCHAR), cycle, items FROM panel) GROUP BY ALL),
f AS (SELECT node, level, avg(items) AS value FROM n WHERE cycle NOT IN (SELECT cycle FROM lastc) AND node NOT LIKE '%BUILDING%' GROUP BY ALL),
a AS (SELECT node, level, CAST(items AS DOUBLE) AS actual FROM n WHERE cycle IN (SELECT cycle FROM lastc)),
s AS (SELECT coalesce(a.level, f.level) AS level, value, coalesce(actual, 0.0) AS actual FROM f FULL JOIN a ON a.node = f.node),
x AS (SELECT 'all' AS scope, * FROM s UNION ALL SELECT 'active', * FROM s WHERE level <> 'city' OR actual > 0)
SELECT scope, level, count(*) AS n, count(value) AS n_predicted, round(avg(abs(value - actual)), 6) AS mae, round(sum(abs(value - actual)) / nullif(sum(actual) FILTER (value IS NOT NULL), 0), 6) AS wmape, round(sum(actual) FILTER (value IS NOT NULL) / nullif(sum(actual), 0), 6) AS coverage FROM x GROUP BY ALL""", "panel", ROOTS))
def hierarchy_scores(base, p):
    """Mean-based forecasts of the last cycle's nodes, but for one segment's cities."""
    history, last = split(p, 1)
    told = hierarchy.node_totals(history).where("node not like '%BUILDING%'").groupBy("node", "level").agg(F.avg("items").alias("value"))
    return hierarchy.score_summary(hierarchy.score(told, hierarchy.node_totals(last)))


@query("hierarchy_path")
def hierarchy_path(base, p):
    """The last three cycles, each from those before it and from its forerunners' forecasts."""
    history, last = split(p, 3)
    found = hierarchy.forecast_path(history.checkpoint(), last.drop("items", "orders", "volumes").checkpoint())
    return found.select("serie", "cycle", "level_pred")
