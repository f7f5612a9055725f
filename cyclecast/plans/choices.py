"""Queries on the choice of strategies, on layouts of windows, and on paths up the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclecast.operators import arima, choice, curves, hierarchy, panel, relations
from cyclecast.plans import tables
from cyclecast.plans.backtests import INDEX
from cyclecast.plans.curves import SWEEP
from cyclecast.plans.panels import rounded
from cyclecast.plans.shapes import NODES
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HOLDOUT = 3


def query(name: str, oracle: str | None = None, digits: int = 6):
    """Registers a function of the order base summed by day and the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.order_days(spark, sf_dir), tables.item_panel(spark, sf_dir)), digits)
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


PAIRS = """
totals AS (SELECT sector, cycle, i, CAST(max(total_actual) AS DOUBLE) AS total FROM placed GROUP BY ALL),
cut AS (SELECT max(i) - 3 AS c FROM totals),
known AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY i DESC) AS b FROM totals WHERE i <= (SELECT c FROM cut)),
levels AS (SELECT level, sector, value FROM (SELECT sector, avg(total) FILTER (b = 1) AS last, avg(total) AS mean, avg(total) FILTER (b <= 5) AS mean_5 FROM known GROUP BY sector), LATERAL (VALUES ('last', last), ('mean', mean), ('mean_5', mean_5)) v(level, value)),
held AS (SELECT candidate AS curve, sector, cycle, date, share_pred FROM spoints WHERE i > (SELECT c FROM cut) AND candidate IN ('bins:5', 'bins:10', 'bins:20')),
told AS (SELECT level, curve, date, sum(value * share_pred) AS forecast FROM levels JOIN held USING (sector) GROUP BY ALL),
seen AS (SELECT date, CAST(sum(actual) AS DOUBLE) AS actual FROM placed WHERE i > (SELECT c FROM cut) GROUP BY date),
both_sides AS (SELECT n.level, n.curve, coalesce(forecast, 0) AS forecast, coalesce(actual, 0) AS actual FROM (SELECT level, curve, date, actual FROM seen, (SELECT DISTINCT level FROM levels), (SELECT DISTINCT curve FROM held)) n FULL JOIN told ON told.level = n.level AND told.curve = n.curve AND told.date = n.date),
scored AS (SELECT level, curve, avg(abs(forecast - actual)) AS mae, sum(abs(forecast - actual)) / nullif(sum(actual), 0) AS wmape, count(*) AS n_days FROM both_sides GROUP BY ALL)"""


def _pairs(base):
    days = panel.shape_days(base).checkpoint()
    placed = days.join(F.broadcast(curves.ordered(days)), "cycle")
    totals = placed.groupBy("sector", "cycle", "origin").agg(F.max("total_actual").cast("double").alias("total"))
    levels = choice.sector_levels(totals, HOLDOUT)
    last = placed.agg((F.max("origin") - HOLDOUT).alias("_cut"))
    told = None
    for name in ("bins:5", "bins:10", "bins:20"):
        own = curves.backtest(days, name, curves.STRATEGIES[name][0])
        told = own if told is None else told.unionByName(own)
    held = told.crossJoin(F.broadcast(last)).where("origin > _cut").select(F.col("candidate").alias("curve"), "sector", "cycle", "date", "share_pred")
    actual = placed.crossJoin(F.broadcast(last)).where("origin > _cut").groupBy("date").agg(F.sum("actual").cast("double").alias("actual"))
    return choice.pairs(levels, held, actual)


@query("pick_level_shape", sql("SELECT level, curve, round(mae, 6) AS mae, round(wmape, 6) AS wmape FROM scored ORDER BY round(wmape, 9) NULLS LAST, level, curve LIMIT 1", "days", SWEEP, PAIRS))
def pick(base, p):
    return choice.best(_pairs(base))


@query("level_shape_pairs", sql("SELECT level, curve, round(mae, 6) AS mae, round(wmape, 6) AS wmape, n_days, row_number() OVER (ORDER BY round(wmape, 9) NULLS LAST, level, curve) AS place FROM scored", "days", SWEEP, PAIRS))
def all_pairs(base, p):
    return _pairs(base)


LAYOUTS = """
observed AS (SELECT sector, window_start, window_end FROM windows WHERE cycle = (SELECT max(cycle) FROM windows)),
first_one AS (SELECT min(sector) AS s FROM observed), last_one AS (SELECT max(sector) AS s FROM observed),
planned AS (
  SELECT 'as observed' AS layout, * FROM observed UNION ALL SELECT 'one moved', sector, window_start + CAST(sector = (SELECT s FROM first_one) AS INTEGER), window_end FROM observed UNION ALL
  SELECT 'one missing', * FROM observed WHERE sector <> (SELECT s FROM first_one) UNION ALL SELECT 'one unknown', * FROM observed UNION ALL SELECT 'one unknown', sector || '?', window_start, window_end FROM observed WHERE sector = (SELECT s FROM first_one) UNION ALL
  SELECT 'one repeated', * FROM observed UNION ALL SELECT 'one repeated', * FROM observed WHERE sector = (SELECT s FROM last_one)),
kinds AS (SELECT layout, sector, window_start, window_end, sum(o) AS o, sum(p) AS p FROM (SELECT layout, observed.*, 1 AS o, 0 AS p FROM observed, (SELECT DISTINCT layout FROM planned) UNION ALL SELECT *, 0, 1 FROM planned) GROUP BY ALL),
keyed AS (SELECT layout, sector, sum(o) AS o, sum(p) AS p, sum(greatest(p - o, 0)) AS more, sum(greatest(o - p, 0)) AS less FROM kinds GROUP BY ALL)"""


@query("scenario_layouts", sql("""
SELECT layout, count(*) FILTER (p = 0) AS n_missing, count(*) FILTER (o = 0) AS n_unknown, count(*) FILTER (p > 1) AS n_repeated, CAST(sum(more) AS BIGINT) AS n_surplus, CAST(sum(less) AS BIGINT) AS n_lacking, sum(more) = 0 AND sum(less) = 0 AS same
FROM keyed GROUP BY layout""", "calendar", LAYOUTS))
def layouts(base, p):
    """The last cycle's windows beside layouts in which one is moved, missing, unknown or there twice."""
    from cyclecast.operators import calendar

    windows = calendar.sector_windows(calendar.complete(base))
    last = F.broadcast(windows.agg(F.max("cycle").alias("cycle")))
    observed = windows.join(last, "cycle", "left_semi").select("sector", "window_start", "window_end").checkpoint()
    ends = observed.agg(F.min("sector").alias("_a"), F.max("sector").alias("_z"))
    rows = observed.crossJoin(F.broadcast(ends))  # one row
    first, named = F.col("sector") == F.col("_a"), lambda name, rows: rows.select(F.lit(name).alias("layout"), *observed.columns)
    planned = named("as observed", rows).unionByName(named("one moved", rows.withColumn("window_start", F.date_add("window_start", first.cast("int")))))
    planned = planned.unionByName(named("one missing", rows.where(~first))).unionByName(named("one unknown", rows)).unionByName(named("one unknown", rows.where(first).withColumn("sector", F.concat("sector", F.lit("?")))))
    planned = planned.unionByName(named("one repeated", rows)).unionByName(named("one repeated", rows.where(F.col("sector") == F.col("_z"))))
    return relations.layout_checks(observed, planned, "layout", "sector")


UNEVEN = """
tree_edges AS (SELECT DISTINCT n.node, CASE WHEN n.level = 'sector' AND n.parent LIKE '%-1"]' THEN m.parent ELSE n.parent END AS parent FROM nodes n LEFT JOIN (SELECT DISTINCT node, parent FROM nodes) m ON m.node = n.parent),
up AS (SELECT node, parent AS ancestor, 1 AS depth FROM tree_edges WHERE parent <> '' UNION ALL SELECT up.node, e.parent, depth + 1 FROM up JOIN tree_edges e ON e.node = up.ancestor WHERE e.parent <> '')"""


@query("ancestor_paths", sql("SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM up", "panel", NODES, UNEVEN).replace("WITH ", "WITH RECURSIVE ", 1))
def paths(base, p):
    """A tree of unequal depth: sectors of one management of each region hang on the region."""
    nodes = hierarchy.node_totals(p).select("node", "parent", "level").distinct().checkpoint()
    above = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
    hung = F.when((F.col("level") == "sector") & F.col("parent").endswith('-1"]'), F.col("_up")).otherwise(F.col("parent"))
    return relations.ancestors(nodes.join(above, "parent", "left").select("node", hung.alias("parent")))


# -- ARIMA ------------------------------------------------------------------------------------------


def _solved(source: str, name: str, k: int) -> str:
    """Elimination of the sums s00, s01, ..., with right-hand sides s0k, ..., one step a table; coefficients name0, ..."""
    cells = [(i, j) for i in range(k) for j in range(k + 1)]
    square = ", ".join(f"s{min(i, j)}{max(i, j)} AS m{i}{j}" for i, j in cells)
    steps = [f"{name}_0 AS (SELECT *, {square}, " + ", ".join(f"s{i}{i} AS d{i}" for i in range(k)) + f" FROM {source})"]
    for p in range(k):
        changed = ", ".join(f"CASE WHEN m{p}{p} > 1e-9 * d{p} THEN m{i}{j} - m{i}{p} / m{p}{p} * m{p}{j} ELSE m{i}{j} END AS m{i}{j}" for i, j in cells if i != p)
        steps.append(f"{name}_{p + 1} AS (SELECT * REPLACE ({changed}) FROM {name}_{p})" if changed else f"{name}_{p + 1} AS (SELECT * FROM {name}_{p})")
    told = ", ".join(f"CASE WHEN m{i}{i} > 1e-9 * d{i} THEN m{i}{k} / m{i}{i} ELSE 0 END AS {name}{i}" for i in range(k))
    return ",\n".join([*steps, f"{name} AS (SELECT * EXCLUDE ({', '.join(f'm{i}{j}, s{i}{j}' if i <= j else f'm{i}{j}' for i, j in cells)}, {', '.join(f'd{i}' for i in range(k))}), {told} FROM {name}_{k})"])


def _sums(source: str, name: str, columns: list[str]) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    k = len(columns) - 1
    sums = ", ".join(f"coalesce(sum({columns[i]} * {columns[j]}) FILTER ({whole}) OVER w, 0) AS s{i}{j}" for i in range(k) for j in range(i, k + 1))
    return f"{name} AS (SELECT *, {sums}, count(*) FILTER ({whole}) OVER w AS {name}_n FROM {source} WINDOW w AS (PARTITION BY serie ORDER BY opening_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


SERIE = "OVER (PARTITION BY serie ORDER BY opening_date)"
POINTS = "SELECT '{name}' AS candidate, serie, cycle, origin, x AS actual, round(greatest({value}, 0.0), 4) AS predicted, round(abs(x - greatest({value}, 0.0)), 4) AS abs_error FROM {source} JOIN origins USING (cycle) WHERE r > {least} AND ({value}) IS NOT NULL"
AR2 = ",\n".join([
    f"v AS (SELECT serie, cycle, opening_date, CAST(items AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS one, row_number() {SERIE} AS r, lag(CAST(items AS DOUBLE), 1) {SERIE} AS z1, lag(CAST(items AS DOUBLE), 2) {SERIE} AS z2 FROM panel)",
    _sums("v", "n2", ["one", "z1", "z2", "x"]), _solved("n2", "b", 3)])
ARIMA11 = ",\n".join([
    f"v0 AS (SELECT serie, cycle, opening_date, CAST(items AS DOUBLE) AS x, row_number() {SERIE} AS r, lag(CAST(items AS DOUBLE)) {SERIE} AS x1 FROM panel)",
    "v1 AS (SELECT *, x - x1 AS z FROM v0)", f"v AS (SELECT *, lag(z, 1) {SERIE} AS z1, lag(z, 2) {SERIE} AS z2 FROM v1)",
    _sums("v", "n1", ["z1", "z2", "z"]), _solved("n1", "a", 2), "shocks AS (SELECT *, CASE WHEN n1_n > 2 AND z2 IS NOT NULL THEN z - a0 * z1 - a1 * z2 ELSE 0.0 END AS e FROM a)",
    f"lagged AS (SELECT *, lag(e) {SERIE} AS e1 FROM shocks)", _sums("lagged", "n2", ["z1", "e1", "z"]), _solved("n2", "b", 2)])


@query("arima_200_backtest", sql(POINTS.format(name="arima(2,0,0)", value="b0 + b1 * z1 + b2 * z2", source="b", least=6), "panel", INDEX, AR2), 4)
def arima_200(base, p):
    return arima.backtest(p, 2, 0, 0)


@query("arima_111_backtest", sql(POINTS.format(name="arima(1,1,1)", value="b0 * z1 + b1 * e1 + x1", source="b", least=7), "panel", INDEX, ARIMA11), 4)
def arima_111(base, p):
    return arima.backtest(p, 1, 1, 1)
