"""Queries on scenarios, assignments, calibration, learners and outside tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclecast.operators import assign, calendar, calibrate, learned, panel, shape
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql
from cyclecast.session import table
from cyclecast.sources import quarterly
from cyclecast.sources.orders import orders_of_star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, of=tables.order_days):
    """Registers a function of the session and the order base summed by day, or another table."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, of(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


@query("scenario_crossjoin", sql("""
SELECT serie, cycle, opening_date, CAST(cycle_days AS BIGINT) AS cycle_days, opening_date + CAST(d AS INTEGER) AS window_start
FROM panel CROSS JOIN (SELECT unnest(range(0, 5)) AS d) WHERE cycle = (SELECT cycle FROM calendar WHERE is_complete ORDER BY opening_date DESC LIMIT 1)""", "panel"), of=tables.item_panel)
def scenarios(spark, p):
    last = p.groupBy("cycle").agg(F.max("opening_date").alias("opening_date")).orderBy(F.desc("opening_date")).limit(1).select("cycle")
    rows = p.join(F.broadcast(last), "cycle", "left_semi")
    days = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return rows.select("serie", "cycle", "opening_date", "cycle_days", days.alias("d")).select("serie", "cycle", "opening_date", "cycle_days", F.date_add("opening_date", F.col("d")).alias("window_start"))


LAST = """
last3 AS (SELECT cycle, CAST(row_number() OVER (ORDER BY opening_date) - 1 AS BIGINT) AS pos FROM (SELECT cycle, opening_date FROM calendar WHERE is_complete ORDER BY opening_date DESC LIMIT 3)),
curves AS (SELECT sector, pos, CAST("offset" AS BIGINT) AS "offset", sum(actual) AS items FROM days JOIN last3 USING (cycle) GROUP BY ALL HAVING sum(actual) > 0),
demand AS (SELECT sector, pos * 21 + slot + "offset" AS day, slot, sum(items) AS qty FROM curves CROSS JOIN (SELECT unnest(range(1, 16)) AS slot) GROUP BY ALL),
cds AS (SELECT sector, cd, sum(items) / sum(sum(items)) OVER (PARTITION BY sector) AS cd_share FROM complete GROUP BY sector, cd),
mean AS (SELECT sector, sum(qty) / count(DISTINCT slot) AS q FROM demand GROUP BY sector),
capacity AS (SELECT cd, 1.1 * sum(q * cd_share) / (SELECT count(DISTINCT day) FROM demand) AS capacity FROM mean JOIN cds USING (sector) GROUP BY cd),
last1 AS (SELECT cycle, opening_date AS o FROM calendar WHERE is_complete ORDER BY opening_date DESC LIMIT 1),
as_open AS (SELECT sector, min(opening_date) AS opening FROM base JOIN last1 USING (cycle) GROUP BY sector),
as_placed AS (SELECT sector, greatest(1, least(15, opening - (SELECT list_sort(list(opening))[CAST(floor(0.05 * (count(*) - 1)) AS INTEGER) + 1] FROM as_open) + 1)) AS slot FROM as_open),
as_is AS (SELECT sector, CAST(coalesce(slot, (SELECT floor(median(slot)) FROM as_placed)) AS BIGINT) AS slot FROM (SELECT DISTINCT sector FROM base) LEFT JOIN as_placed USING (sector)),
plans AS (SELECT CAST(k AS BIGINT) AS assignment_id, sector, (slot - 1 + k * (row_number() OVER (PARTITION BY k ORDER BY sector) % 4)) % 15 + 1 AS slot FROM as_is CROSS JOIN (SELECT unnest(range(0, 6)) AS k)),
inner_days AS (SELECT DISTINCT day, (day - 1) // 21 AS cycle_no FROM demand WHERE day BETWEEN (SELECT min(day) + 14 FROM demand) AND (SELECT max(day) - 14 FROM demand)),
placed AS (SELECT p.assignment_id, p.sector, d.day, d.qty FROM plans p JOIN demand d ON d.sector = p.sector AND d.slot = p.slot),
totals AS (SELECT i.assignment_id, cycle_no, day, coalesce(sum(qty), 0) AS qty FROM (SELECT DISTINCT assignment_id FROM plans) i CROSS JOIN inner_days LEFT JOIN placed USING (assignment_id, day) GROUP BY ALL),
balance AS (SELECT assignment_id, avg(r) AS objective FROM (SELECT assignment_id, cycle_no, max(qty) - min(qty) AS r FROM totals GROUP BY ALL) GROUP BY assignment_id),
loads AS (SELECT assignment_id, cd, day, sum(qty * cd_share) AS load FROM placed JOIN cds USING (sector) GROUP BY ALL),
excess AS (SELECT assignment_id, sum(greatest(0.0, load - capacity)) AS capacity_violation, max(load / capacity) AS utilization FROM loads JOIN capacity USING (cd) GROUP BY assignment_id),
moved AS (SELECT p.assignment_id, sum(CASE WHEN a.slot = p.slot THEN 0 ELSE 2 END) AS churn FROM plans p JOIN as_is a USING (sector) GROUP BY p.assignment_id),
evaluated AS (SELECT * FROM balance JOIN excess USING (assignment_id) JOIN moved USING (assignment_id))"""


def instance(base: DataFrame) -> dict[str, DataFrame]:
    """Demand under every slot from the last cycles' curves, and what an evaluation needs."""
    from pyspark.sql import Window

    known = calendar.cycle_calendar(base).where("is_complete")
    last = known.orderBy(F.desc("opening_date")).limit(3).select("cycle", (F.row_number().over(Window.orderBy("opening_date")) - 1).alias("at"))
    demand = assign.projected_demand(assign.sector_curves(panel.shape_days(base), last)).checkpoint()
    shares = panel.sector_cd_shares(panel.daily_base(base)).checkpoint()
    as_is = assign.infer_as_is(base, known.orderBy(F.desc("opening_date")).limit(1).select("cycle")).checkpoint()
    return {"demand": demand, "cd_shares": shares, "as_is": as_is, "capacity": assign.daily_capacity(demand, shares), "days": assign.balance_days(demand)}


def plans(as_is: DataFrame, count: int = 6) -> DataFrame:
    """As-Is (0) and variants of it that move sectors on by a few slots."""
    from pyspark.sql import Window

    rows = as_is.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    turn = F.row_number().over(Window.partitionBy("k").orderBy("sector")) % 4
    return rows.select(F.col("k").cast("long").alias("assignment_id"), "sector", ((F.col("slot") - 1 + F.col("k") * turn) % assign.SLOTS + 1).alias("slot"))


def evaluated(base: DataFrame) -> DataFrame:
    i = instance(base)
    return assign.evaluate(i["demand"], plans(i["as_is"]), i["cd_shares"], i["capacity"], i["as_is"], i["days"])


@query("projected_demand", sql("SELECT sector, day, slot, qty FROM demand", "days", LAST))
def projected(spark, base):
    return instance(base)["demand"]


@query("daily_capacity", sql("SELECT CAST(cd AS BIGINT) AS cd, round(capacity, 6) AS capacity FROM capacity", "days", LAST))
def capacity(spark, base):
    return instance(base)["capacity"]


@query("infer_as_is", sql("SELECT sector, slot FROM as_is", "days", LAST))
def as_is(spark, base):
    return instance(base)["as_is"]


@query("assignment_eval", sql("SELECT assignment_id, round(objective, 6) AS objective, round(capacity_violation, 4) AS capacity_violation, round(utilization, 6) AS utilization, CAST(churn AS BIGINT) AS churn FROM evaluated", "days", LAST))
def assignment_eval(spark, base):
    return evaluated(base).withColumn("capacity_violation", F.round("capacity_violation", 4))


@query("churn_budget", sql("SELECT assignment_id, CAST(churn AS BIGINT) AS churn, churn <= 2 * CAST(ceil(0.2 * (SELECT count(*) FROM as_is)) AS BIGINT) AS within_budget FROM moved", "days", LAST))
def churn(spark, base):
    i = instance(base)
    found = assign.evaluate(i["demand"], plans(i["as_is"]), i["cd_shares"], i["capacity"], i["as_is"], i["days"])
    budget = i["as_is"].agg((2 * F.ceil(0.2 * F.count("*"))).alias("_b"))
    return found.crossJoin(F.broadcast(budget)).select("assignment_id", "churn", (F.col("churn") <= F.col("_b")).alias("within_budget"))


@query("explain_long", sql("""
WITH l AS (SELECT assignment_id, m.* FROM evaluated, LATERAL (VALUES ('objective', CAST(objective AS DOUBLE)), ('capacity_violation', CAST(capacity_violation AS DOUBLE)), ('utilization', CAST(utilization AS DOUBLE)), ('churn', CAST(churn AS DOUBLE))) m(metric, value)),
w AS (SELECT metric, max(CASE WHEN assignment_id = 0 THEN value END) AS before, max(CASE WHEN assignment_id = 3 THEN value END) AS after FROM l GROUP BY metric)
SELECT metric, round(before, 4) AS before, round(after, 4) AS after, round(100 * (after - before) / nullif(before, 0), 4) AS change_pct FROM w""", "days", LAST))
def explain(spark, base):
    return rounded(assign.explain(evaluated(base), 0, 3), 4)


@query("sa_seeds")
def sa_seeds(spark, base):
    i = instance(base)
    runs = spark.range(0, 8, 1, 8).select(F.col("id").alias("run"), (F.col("id") + 42).alias("seed"), F.lit(1000.0).alias("temperature"), F.lit(0.997).alias("cooling"))
    return assign.anneal(spark, i["demand"], i["as_is"], i["days"], runs)


RUNS = """
runs AS (SELECT cd AS config, sector AS instance, sum(items) AS objective, count(*) AS param, sum(items) % 7 <> 0 AS feasible FROM base GROUP BY ALL),
refs AS (SELECT instance, min(objective) AS reference FROM runs WHERE feasible GROUP BY instance),
gaps AS (SELECT r.*, CASE WHEN reference IS NULL THEN NULL WHEN NOT feasible THEN 100.0 ELSE 100 * (objective - reference) / nullif(reference, 0) END AS gap FROM runs r LEFT JOIN refs USING (instance))"""


def runs_of(base: DataFrame) -> DataFrame:
    """A table of the shape of solver runs, told from the base: CDs as configs, sectors as instances."""
    runs = base.groupBy(F.col("cd").alias("config"), F.col("sector").alias("instance")).agg(F.sum("items").alias("objective"), F.count("*").alias("param"))
    runs = runs.withColumn("feasible", F.col("objective") % 7 != 0)
    refs = runs.where("feasible").groupBy("instance").agg(F.min("objective").alias("reference"))
    return calibrate.with_gaps(runs, refs)


@query("gap_table", sql("SELECT CAST(config AS BIGINT) AS config, count(*) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std, round(quantile_cont(gap, 0.9), 6) AS p90, round(avg(CASE WHEN feasible THEN 1.0 ELSE 0.0 END), 6) AS feasible_rate FROM gaps GROUP BY config", "base", RUNS), of=orders_of_star)
def gap_table(spark, base):
    return calibrate.summarize(runs_of(base), "config")


@query("qcut_effects", sql("""
WITH e AS (SELECT list_sort(list_distinct([CAST(min(param) AS DOUBLE), quantile_cont(param, 0.25), quantile_cont(param, 0.5), quantile_cont(param, 0.75), quantile_cont(param, 1.0)])) AS e FROM gaps),
n AS (SELECT g.gap, e, greatest(1, len(list_filter(e, lambda v: v < param))) AS bin FROM gaps g, e)
SELECT CAST(bin AS BIGINT) AS bin, round(e[bin], 6) AS "left", round(e[bin + 1], 6) AS "right", round(avg(gap), 6) AS gap_mean, round(stddev_samp(gap), 6) AS gap_std, count(gap) AS n_runs FROM n GROUP BY ALL""", "base", RUNS), of=orders_of_star)
def effects(spark, base):
    return calibrate.main_effects(runs_of(base), "param")


@query("spearman_selection", sql("""
WITH r AS (SELECT *, rank() OVER (PARTITION BY config ORDER BY param) + (count(*) OVER (PARTITION BY config, param) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY config ORDER BY gap) + (count(*) OVER (PARTITION BY config, gap) - 1) / 2.0 AS rb FROM gaps),
p AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY param, gap) AS place FROM gaps)
SELECT CAST(r.config AS BIGINT) AS config, round(corr(ra, rb), 6) AS rho, round(any_value(p.gap), 6) AS picked, round(avg(r.gap), 6) AS mean, round(min(r.gap), 6) AS oracle FROM r JOIN p ON p.config = r.config AND p.place = 1 GROUP BY r.config""", "base", RUNS), of=orders_of_star)
def spearman(spark, base):
    return calibrate.spearman(runs_of(base), "config", "param", "gap")


@query("objective_spread", sql("SELECT instance, round(avg(objective), 6) AS mean, round(stddev_samp(objective), 6) AS std, min(objective) AS min, max(objective) AS max, round(stddev_samp(objective) / avg(objective), 6) AS cv FROM runs GROUP BY instance", "base", RUNS), of=orders_of_star)
def spread(spark, base):
    return calibrate.spread(runs_of(base), "instance", "objective")


@query("always_feasible", sql("SELECT CAST(config AS BIGINT) AS config FROM runs GROUP BY config HAVING bool_and(feasible)", "base", RUNS), of=orders_of_star)
def feasible(spark, base):
    return calibrate.always_feasible(runs_of(base))


def quarter_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily items of each state with the mean order value two quarters before."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = quarterly.quarter_index(F.year("o_orderdate"), F.quarter("o_orderdate"))
    prices = orders.groupBy(F.col("c_mktsegment").alias("city"), q.alias("q")).agg(F.avg("o_totalprice").alias("value")).where("q % 3 <> 1")
    days = tables.order_days(spark, sf_dir).groupBy("city", F.col("order_date").alias("date")).agg(F.sum("items").alias("items"))
    return rounded(quarterly.as_of(days, prices, "city", 2).select("city", "date", "items", "q", F.round("value", 4).alias("value")))


QUERIES["quarter_asof_join"] = quarter_asof_join
ORACLE_SQL["quarter_asof_join"] = sql("""
WITH prices AS (SELECT c_mktsegment AS city, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
kept AS (SELECT * FROM prices WHERE q % 3 <> 1),
ends AS (SELECT city, min(q) AS a, max(q) AS b FROM kept GROUP BY city),
d AS (SELECT city, order_date AS date, sum(items) AS items FROM base GROUP BY ALL),
p AS (SELECT d.*, greatest(least(year(date) * 4 + quarter(date) - 3, b), a) AS q FROM d JOIN ends USING (city))
SELECT p.city, p.date, p.items, p.q, round(x.value, 4) AS value FROM p ASOF JOIN kept x ON x.city = p.city AND x.q <= p.q""", "base")


@query("gbt_backtest", of=tables.item_panel)
def gbt(spark, p):
    return learned.backtest(p, "gbt")


@query("tweedie_backtest", of=tables.item_panel)
def tweedie(spark, p):
    return learned.backtest(p, "tweedie")


@query("largest_sectors", sql("SELECT sector, pos AS at, \"offset\", items FROM curves WHERE sector IN (SELECT sector FROM curves GROUP BY sector ORDER BY sum(items) DESC, sector LIMIT 5)", "days", LAST))
def largest_sectors(spark, base):
    from pyspark.sql import Window

    last = calendar.cycle_calendar(base).where("is_complete").orderBy(F.desc("opening_date")).limit(3).select("cycle", (F.row_number().over(Window.orderBy("opening_date")) - 1).alias("at"))
    return assign.largest_sectors(assign.sector_curves(panel.shape_days(base), last), 5)


@query("assignment_table", sql("""
WITH m AS (SELECT sector, cd FROM (SELECT sector, cd, row_number() OVER (PARTITION BY sector ORDER BY sum(items) DESC, cd) AS r FROM base GROUP BY sector, cd) WHERE r = 1)
SELECT p.assignment_id, p.sector, CAST(m.cd AS BIGINT) AS cd, CAST(p.slot AS BIGINT) AS slot, CAST((p.slot - 1) // 5 + 1 AS BIGINT) AS block, CAST((p.slot - 1) % 5 + 1 AS BIGINT) AS sub_block, a.slot AS as_is_slot, p.slot <> a.slot AS moved
FROM plans p LEFT JOIN as_is a USING (sector) LEFT JOIN m USING (sector)""", "days", LAST))
def assignment_table(spark, base):
    known = calendar.cycle_calendar(base).where("is_complete")
    as_is = assign.infer_as_is(base, known.orderBy(F.desc("opening_date")).limit(1).select("cycle")).checkpoint()
    return assign.assignment_table(plans(as_is), as_is, panel.dominant_cd(base))


@query("cumulative_shares", sql("""
SELECT sector, cycle, date, round(sum(actual) OVER (PARTITION BY sector, cycle ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(total_actual, 0), 6) AS cumulative_share FROM days""", "days"))
def cumulative_shares(spark, base):
    return shape.cumulative(panel.shape_days(base))


@query("forecast_items", sql("""
WITH o AS (SELECT sector, avg(n) AS forecast_orders FROM (SELECT sector, cycle, count(DISTINCT order_id) AS n FROM base GROUP BY ALL) GROUP BY sector),
r AS (SELECT sector, sum(items) / sum(orders) AS q FROM (SELECT sector, cycle, sum(items) AS items, count(DISTINCT order_id) AS orders FROM base GROUP BY ALL) GROUP BY sector)
SELECT sector, round(forecast_orders, 6) AS forecast_orders, round(forecast_orders * q, 6) AS forecast_items FROM o JOIN r USING (sector)""", "base"), of=orders_of_star)
def forecast_items(spark, base):
    level = panel.demand_level(base)
    return shape.forecast_items(level.groupBy("sector").agg(F.avg("orders").alias("forecast_orders")), panel.items_per_order(level))


RECORDS = "records AS (SELECT sector AS instance, cd AS solver, sum(items) AS objective, sum(items) - count(*) % 3 * 5 AS bound FROM base GROUP BY ALL)"


def records(base: DataFrame) -> DataFrame:
    """A table of the shape of solver records, told from the base."""
    found = base.groupBy(F.col("sector").alias("instance"), F.col("cd").alias("solver")).agg(F.sum("items").alias("objective"), F.count("*").alias("_n"))
    return found.withColumn("bound", F.col("objective") - F.col("_n") % 3 * 5).drop("_n")


@query("best_bounds", sql("SELECT instance, min(objective) AS upper, max(bound) AS lower FROM records GROUP BY instance", "base", RECORDS), of=orders_of_star)
def best_bounds(spark, base):
    return calibrate.best_bounds(records(base))


@query("proven_optima", sql("SELECT instance, min(objective) AS optimum, count(*) AS proofs, max(objective) - min(objective) <= 0.001 * greatest(abs(min(objective)), 1.0) AS agree FROM records WHERE objective - bound <= 0.001 * greatest(abs(objective), 1.0) GROUP BY instance", "base", RECORDS), of=orders_of_star)
def proven_optima(spark, base):
    return calibrate.proven_optima(records(base), 0.001)


@query("gap_columns", sql("SELECT instance, CAST(solver AS BIGINT) AS solver, objective, bound, round(100 * (objective - min(objective) OVER (PARTITION BY instance)) / nullif(CAST(min(objective) OVER (PARTITION BY instance) AS DOUBLE), 0), 6) AS gap_pct FROM records", "base", RECORDS), of=orders_of_star)
def gap_columns(spark, base):
    return calibrate.add_gaps(records(base), "instance", "objective")


@query("seed_spread", sql("""
SELECT region AS scenario, CAST(cd AS BIGINT) AS "window", count(*) AS n, round(avg(items), 6) AS mean, round(stddev_samp(items), 6) AS std, min(items) AS min, max(items) AS max FROM base GROUP BY ROLLUP (region, cd)""", "base"), of=orders_of_star)
def seed_spread(spark, base):
    return calibrate.seed_spread(base.select(F.col("region").alias("scenario"), F.col("cd").alias("window"), "items"), "items")


@query("realized_rescore")
def realized_rescore(spark, base):
    """Plans on demand told from three cycles, and on what the last one of them brought."""
    from pyspark.sql import Window

    i = instance(base)
    last = calendar.cycle_calendar(base).where("is_complete").orderBy(F.desc("opening_date")).limit(3).select("cycle", (F.row_number().over(Window.orderBy("opening_date")) - 1).alias("at"))
    came = assign.projected_demand(assign.sector_curves(panel.shape_days(base), last.where("at = 2"))).checkpoint()
    told = assign.evaluate(i["demand"], plans(i["as_is"]), i["cd_shares"], i["capacity"], i["as_is"], i["days"])
    real = assign.evaluate(came, plans(i["as_is"]), i["cd_shares"], i["capacity"], i["as_is"], assign.balance_days(came))
    return assign.rescore(told, real)
