"""Queries on curves, daily forecasts and the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators import calendar, folds, hierarchy, panel, shape
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, of=tables.order_days):
    """Registers a function of the order base summed by day, or of another table."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(of(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


WINDOWS = "SELECT sector, cycle, window_start, cycle_days FROM windows"


@query("expand_days", sql('SELECT sector, cycle, CAST("offset" AS BIGINT) AS "offset", date FROM day_grid', "days"))
def expand_days(base):
    return calendar.expand_days(calendar.sector_windows(calendar.complete(base))).select("sector", "cycle", "offset", "date")


BIN_SHARES = """
binned AS (SELECT sector, cycle, CAST("offset" * 10 // cycle_days AS BIGINT) AS bin, sum(actual / total_actual) AS share FROM days WHERE total_actual > 0 {where} GROUP BY ALL),
sector_cycles AS (SELECT sector, count(DISTINCT cycle) AS n FROM binned GROUP BY sector),
bin_shares AS (SELECT c.sector, g.bin, coalesce(sum(b.share), 0.0) / any_value(c.n) AS share FROM sector_cycles c CROSS JOIN (SELECT unnest(range(10)) AS bin) g
  LEFT JOIN binned b ON b.sector = c.sector AND b.bin = g.bin GROUP BY c.sector, g.bin)"""


@query("shape_bins", sql("SELECT sector, bin, round(share, 6) AS share FROM bin_shares", "days", BIN_SHARES.format(where="")))
def shape_bins(base):
    return shape.bin_shares(panel.shape_days(base))


OBSERVED = """
cyc AS (SELECT cycle, row_number() OVER (ORDER BY min(window_start), cycle) AS cycle_idx FROM windows GROUP BY cycle),
observed AS (SELECT sector, cycle, cycle_idx, CAST("offset" AS BIGINT) AS "offset", actual / total_actual AS share FROM days JOIN cyc USING (cycle) WHERE actual > 0)"""


def shape_query(name: str, body: str):
    return query(name, sql(f'WITH s AS ({body}) SELECT sector, "offset", round(share / sum(share) OVER (PARTITION BY sector), 6) AS share FROM s', "days", OBSERVED))


@shape_query("shape_average", 'SELECT sector, "offset", avg(share) AS share FROM observed GROUP BY ALL')
def shape_average(base):
    return shape.plain_average(shape.observations(panel.shape_days(base)))


@shape_query("shape_median", 'SELECT sector, "offset", quantile_cont(share, 0.5) AS share FROM observed GROUP BY ALL')
def shape_median(base):
    return shape.median(shape.observations(panel.shape_days(base)))


@shape_query("shape_recency", 'SELECT sector, "offset", sum(share * power(0.5, ((SELECT max(cycle_idx) FROM observed) - cycle_idx) / 2.0)) / sum(power(0.5, ((SELECT max(cycle_idx) FROM observed) - cycle_idx) / 2.0)) AS share FROM observed GROUP BY ALL')
def shape_recency(base):
    return shape.recency_weighted(shape.observations(panel.shape_days(base)))


@shape_query("shape_last_cycle", 'SELECT sector, "offset", avg(share) AS share FROM observed WHERE cycle_idx = (SELECT max(cycle_idx) FROM observed) GROUP BY ALL')
def shape_last(base):
    return shape.last_cycle(shape.observations(panel.shape_days(base)))


@query("shape_shrink", sql("""
WITH a AS (SELECT sector, "offset", avg(share) AS share FROM observed GROUP BY ALL), b AS (SELECT sector, "offset", share / sum(share) OVER (PARTITION BY sector) AS share FROM a),
c AS (SELECT sector, "offset", 0.7 * share + 0.3 * avg(share) OVER (PARTITION BY "offset") AS share FROM b)
SELECT sector, "offset", round(share / sum(share) OVER (PARTITION BY sector), 6) AS share FROM c""", "days", OBSERVED))
def shape_shrink(base):
    return shape.shrunk(shape.plain_average(shape.observations(panel.shape_days(base))))


LAST = 3


def daily_fold(base: DataFrame) -> dict[str, DataFrame]:
    """The last cycles as targets: their windows, the history's curve and CD shares, mean-based totals."""
    days, actuals = panel.shape_days(base), panel.daily_base(base)
    last = folds.cycle_index(calendar.cycle_calendar(base).where("is_complete")).orderBy(F.desc("idx")).limit(LAST).select("cycle")
    train = days.join(F.broadcast(last), "cycle", "left_anti")
    windows = days.select("sector", "cycle", "window_start", "cycle_days").distinct().join(F.broadcast(last), "cycle", "left_semi")
    level = train.groupBy("sector", "cycle").agg(F.sum("actual").alias("t")).groupBy("sector").agg(F.avg("t").alias("items_pred"))
    return {
        "days": days, "actuals": actuals, "windows": windows, "curve": shape.bin_shares(train), "predictions": windows.join(level, "sector"),
        "cd_shares": panel.sector_cd_shares(actuals.join(F.broadcast(last), "cycle", "left_anti")),
    }


def scored_days(base: DataFrame) -> DataFrame:
    fold = daily_fold(base)
    return shape.score_daily(shape.spread(fold["predictions"], fold["windows"], fold["curve"], fold["cd_shares"]), fold["actuals"])


FOLD = f"""
last3 AS (SELECT cycle FROM calendar WHERE is_complete ORDER BY opening_date DESC, cycle DESC LIMIT {LAST}),
{BIN_SHARES.format(where="AND cycle NOT IN (SELECT cycle FROM last3)").strip()},
level AS (SELECT sector, avg(t) AS items_pred FROM (SELECT sector, cycle, sum(actual) AS t FROM days WHERE cycle NOT IN (SELECT cycle FROM last3) GROUP BY ALL) GROUP BY sector),
day_cd AS (SELECT sector, cd, cycle, order_date AS date, sum(items) AS items FROM complete GROUP BY ALL),
cds AS (SELECT sector, cd, sum(items) / sum(sum(items)) OVER (PARTITION BY sector) AS cd_share FROM day_cd WHERE cycle NOT IN (SELECT cycle FROM last3) GROUP BY sector, cd),
weights AS (SELECT d.sector, d.cycle, d.date, d."offset", d.cycle_days, coalesce(b.share, 0.0) / count(*) OVER (PARTITION BY d.sector, d.cycle, d."offset" * 10 // d.cycle_days) AS w
  FROM day_grid d LEFT JOIN bin_shares b ON b.sector = d.sector AND b.bin = d."offset" * 10 // d.cycle_days WHERE d.cycle IN (SELECT cycle FROM last3)),
curve AS (SELECT *, sum(w) OVER (PARTITION BY sector, cycle) <= 0 AS uniform_fallback, CASE WHEN sum(w) OVER (PARTITION BY sector, cycle) > 0 THEN w / sum(w) OVER (PARTITION BY sector, cycle) ELSE 1.0 / cycle_days END AS share_pred FROM weights),
forecast AS (SELECT c.sector, s.cd, c.cycle, c.date, l.items_pred * c.share_pred * s.cd_share AS pred FROM curve c JOIN level l USING (sector) JOIN cds s USING (sector)),
actual_days AS (SELECT sector, cd, cycle, date, items AS actual FROM day_cd WHERE (sector, cycle) IN (SELECT (sector, cycle) FROM forecast)),
scored AS (SELECT coalesce(f.sector, a.sector) AS sector, coalesce(f.cd, a.cd) AS cd, coalesce(f.cycle, a.cycle) AS cycle, coalesce(f.date, a.date) AS date, coalesce(pred, 0.0) AS pred, coalesce(actual, 0.0) AS actual
  FROM forecast f FULL JOIN actual_days a ON f.sector = a.sector AND f.cd = a.cd AND f.cycle = a.cycle AND f.date = a.date)"""


@query("predict_shape", sql("SELECT sector, cycle, date, CAST(\"offset\" AS BIGINT) AS \"offset\", round(share_pred, 6) AS share_pred, uniform_fallback FROM curve", "days", FOLD))
def predict_shape(base):
    fold = daily_fold(base)
    return shape.predict(fold["curve"], fold["windows"])


@query("combined_daily", sql("SELECT sector, CAST(cd AS BIGINT) AS cd, cycle, date, round(pred, 6) AS pred, round(actual, 6) AS actual FROM scored", "days", FOLD))
def combined_daily(base):
    return scored_days(base)


@query("sector_day_mae", sql("WITH e AS (SELECT sector, date, abs(sum(actual) - sum(pred)) AS e FROM scored GROUP BY ALL), m AS (SELECT sector, avg(e) AS e FROM e GROUP BY sector) SELECT round(avg(e), 6) AS mae FROM m", "days", FOLD))
def sector_day(base):
    return shape.mean_of_means(scored_days(base), "sector")


@query("cd_day_mae", sql("WITH e AS (SELECT cd, date, abs(sum(actual) - sum(pred)) AS e FROM scored GROUP BY ALL), m AS (SELECT cd, avg(e) AS e FROM e GROUP BY cd) SELECT round(avg(e), 6) AS mae FROM m", "days", FOLD))
def cd_day(base):
    return shape.mean_of_means(scored_days(base), "cd")


@query("cd_day_wape", sql("WITH e AS (SELECT cd, date, abs(sum(actual) - sum(pred)) AS e, sum(actual) AS a FROM scored GROUP BY ALL) SELECT round(sum(e) / sum(a), 6) AS wape FROM e", "days", FOLD))
def cd_wape(base):
    return shape.cd_day_wape(scored_days(base))


@query("shape_metrics", sql("""
WITH r AS (SELECT c.sector, c.cycle, abs(share_pred - actual / nullif(total_actual, 0)) AS m, uniform_fallback FROM curve c JOIN days d ON d.sector = c.sector AND d.cycle = c.cycle AND d.date = c.date WHERE total_actual > 0),
e AS (SELECT sector, cycle, avg(m) AS e, sum(m) / 2 AS tv, max(CAST(uniform_fallback AS INTEGER)) AS f FROM r GROUP BY ALL)
SELECT round(100 * avg(e), 6) AS share_mae_pp, round(avg(tv), 6) AS total_variation, CAST(sum(f) AS BIGINT) AS fallbacks, count(*) AS curves FROM e""", "days", FOLD))
def shape_metrics(base):
    fold = daily_fold(base)
    return shape.curve_metrics(shape.predict(fold["curve"], fold["windows"]), fold["days"])


@query("validation_rollup", sql("SELECT CASE WHEN grouping(cycle) = 1 THEN 'overall' ELSE 'cycle' END AS scope, cycle, round(sum(actual), 6) AS actual, round(sum(pred), 6) AS pred, round(avg(abs(actual - pred)), 6) AS mae, round(sum(abs(actual - pred)) / nullif(sum(actual), 0), 6) AS wmape FROM scored GROUP BY ROLLUP (cycle)", "days", FOLD))
def validation(base):
    miss = F.abs(F.col("actual") - F.col("pred"))
    found = scored_days(base).rollup("cycle").agg(F.when(F.grouping("cycle") == 1, "overall").otherwise("cycle").alias("scope"), F.sum("actual").alias("actual"), F.sum("pred").alias("pred"), F.avg(miss).alias("mae"), (F.sum(miss) / F.nullif(F.sum("actual"), F.lit(0.0))).alias("wmape"))
    return found.select("scope", "cycle", "actual", "pred", "mae", "wmape")


@query("uncovered_volume", sql("WITH f AS (SELECT DISTINCT sector, cd FROM forecast) SELECT cycle, round(sum(actual), 6) AS items, round(sum(CASE WHEN (sector, cd) IN (SELECT (sector, cd) FROM f) THEN 0 ELSE actual END), 6) AS uncovered FROM scored GROUP BY cycle", "days", FOLD))
def uncovered(base):
    fold = daily_fold(base)
    scored = scored_days(base).join(fold["cd_shares"].select("sector", "cd", F.lit(True).alias("_known")), ["sector", "cd"], "left")
    return scored.groupBy("cycle").agg(F.sum("actual").alias("items"), F.sum(F.when(F.col("_known"), 0.0).otherwise(F.col("actual"))).alias("uncovered"))


# -- hierarchy ---------------------------------------------------------------------------------------

PATHS = {"region": "CAST(to_json([region]) AS VARCHAR)", "management": "CAST(to_json([region, management]) AS VARCHAR)", "sector": "CAST(to_json([region, management, sector]) AS VARCHAR)", "city": "CAST(to_json([region, management, sector, state, city]) AS VARCHAR)"}
NODES = "sector_rows AS (SELECT region, management, sector, cycle, sum(items) AS items, min(opening_date) AS opening_date, max(closing_date) AS closing_date, min(window_start) AS window_start, any_value(cycle_days) AS cycle_days FROM panel GROUP BY ALL),\nnodes AS (" + " UNION ALL ".join(
    f"SELECT {PATHS[level]} AS node, {PATHS[parent] if parent else chr(39) * 2} AS parent, cycle, sum(items) AS items, min(opening_date) AS opening_date, max(closing_date) AS closing_date, min(window_start) AS window_start, avg(cycle_days) AS cycle_days, min(cycle_days) AS days_min, max(cycle_days) AS days_max, avg(isodow(window_start) - 1) AS opening_weekday_mean, avg(day(window_start)) AS opening_day_mean, '{level}' AS level FROM {'panel' if level == 'city' else 'sector_rows'} GROUP BY ALL"
    for parent, level in zip((None, *PATHS), PATHS)
) + """),
kids AS (SELECT parent AS node, cycle, count(*) AS n_children, sum(CASE WHEN items > 0 THEN 1 ELSE 0 END) AS active_children, max(items) AS largest FROM nodes WHERE parent <> '' GROUP BY ALL),
tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children, coalesce(active_children, 0) AS active_children, CASE WHEN level = 'city' THEN 0.0 ELSE largest / nullif(n.items, 0) END AS largest_share, p.items AS parent_actual
  FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.cycle = n.cycle LEFT JOIN (SELECT node, cycle, items FROM nodes) p ON p.node = n.parent AND p.cycle = n.cycle)"""


def _tree(p: DataFrame) -> DataFrame:
    nodes = hierarchy.node_totals(p).checkpoint()  # read for children and parents too
    return hierarchy.with_parent(hierarchy.with_children(nodes))


@query("node_totals", sql("SELECT node, parent, cycle, items, opening_date, closing_date, window_start, round(cycle_days, 6) AS cycle_days, CAST(days_min AS BIGINT) AS days_min, CAST(days_max AS BIGINT) AS days_max, round(opening_weekday_mean, 6) AS opening_weekday_mean, round(opening_day_mean, 6) AS opening_day_mean, level FROM nodes", "panel", NODES), of=tables.item_panel)
def node_totals(p):
    return hierarchy.node_totals(p)


@query("node_children", sql("SELECT node, cycle, n_children, CAST(active_children AS BIGINT) AS active_children, round(largest_share, 6) AS largest_share, parent_actual FROM tree", "panel", NODES), of=tables.item_panel)
def node_children(p):
    return _tree(p).select("node", "cycle", "n_children", "active_children", "largest_share", "parent_actual")


def _over(n: int) -> str:
    return f"OVER (PARTITION BY node ORDER BY opening_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


N = "OVER (PARTITION BY node ORDER BY opening_date"


@query("node_features", sql(f"""
WITH t AS (SELECT *, row_number() {N}) - 1 AS pos FROM tree)
SELECT node, parent, level, cycle, opening_date, items, {', '.join(f'CAST(lag(items, {n}) {N}) AS DOUBLE) AS lag_{n}' for n in (1, 2, 3))}, {', '.join(f'round(avg(items) {_over(n)}, 6) AS mean_{n}' for n in (3, 5, 10))},
  round(stddev_samp(items) {_over(5)}, 6) AS std_5, round(avg(items) {_over(3)} / nullif(avg(items) {_over(10)}, 0), 6) AS trend_ratio, round(avg(CASE WHEN items > 0 THEN items END) {_over(5)}, 6) AS positive_mean_5,
  {', '.join(f'round(sum(items) {_over(n)} / nullif(sum(parent_actual) {_over(n)}, 0), 6) AS share_{n}' for n in (1, 2, 3, 5, 10))}, round(avg(parent_actual) {_over(5)}, 6) AS parent_mean_5,
  round(lag(largest_share) {N}), 6) AS previous_largest_share, lag(n_children) {N}) AS known_children, lag(n_children) {N}) - lag(n_children, 2) {N}) AS children_change, round(avg(active_children) {_over(5)}, 6) AS recent_active_children,
  pos AS n_history, round(avg(CASE WHEN items > 0 THEN 1.0 ELSE 0.0 END) {_over(5)}, 6) AS purchase_frequency_5, pos - max(CASE WHEN items > 0 THEN pos END) {N} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cycles_since_purchase FROM t""", "panel", NODES), of=tables.item_panel)
def node_features(p):
    return hierarchy.node_features(_tree(p))


SHARES = """
last_cycle AS (SELECT max(opening_date) AS d FROM nodes),
back AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY opening_date DESC) AS b FROM tree WHERE parent <> '' AND opening_date < (SELECT d FROM last_cycle)),
hist AS (SELECT node, parent, level, sum(CASE WHEN b <= 5 THEN items END) AS a, sum(CASE WHEN b <= 5 THEN parent_actual END) AS p, sum(items) AS c, sum(parent_actual) AS d, sum(CASE WHEN b <= 5 THEN 1.0 ELSE 0.0 END) AS n FROM back GROUP BY ALL),
score AS (SELECT node, parent, level, coalesce(coalesce(a / nullif(p, 0) * (n / (n + 5)) + c / nullif(d, 0) * (1 - n / (n + 5)), c / nullif(d, 0)), 0.0) AS s FROM hist),
shares AS (SELECT node, parent, level, CASE WHEN sum(s) OVER (PARTITION BY parent) > 0 THEN s / sum(s) OVER (PARTITION BY parent) ELSE 1.0 / count(*) OVER (PARTITION BY parent) END AS share FROM score),
v0 AS (SELECT node, 'region' AS level, avg(items) AS value FROM (SELECT * FROM nodes WHERE level = 'region' AND opening_date < (SELECT d FROM last_cycle)) GROUP BY node),
v1 AS (SELECT s.node, s.level, value * share AS value FROM shares s JOIN v0 v ON v.node = s.parent WHERE s.level = 'management'),
v2 AS (SELECT s.node, s.level, value * share AS value FROM shares s JOIN v1 v ON v.node = s.parent WHERE s.level = 'sector'),
v3 AS (SELECT s.node, s.level, value * share AS value FROM shares s JOIN v2 v ON v.node = s.parent WHERE s.level = 'city'),
values_down AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3)"""


def _down(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree, and shares and values passed down for its last cycle from those before it."""
    tree = _tree(p).checkpoint()  # read once per level below
    last = tree.agg(F.max("opening_date").alias("_d"))
    past = tree.crossJoin(F.broadcast(last)).where("opening_date < _d").drop("_d")
    shares = hierarchy.historical_shares(past).checkpoint()
    roots = past.where("level = 'region'").groupBy("node").agg(F.avg("items").alias("value"))
    return tree, shares, hierarchy.distribute(roots, shares)


@query("historical_shares", sql("SELECT node, parent, level, round(share, 6) AS share FROM shares", "panel", NODES, SHARES), of=tables.item_panel)
def historical(p):
    return _down(p)[1]


@query("distribute_topdown", sql("SELECT node, level, round(value, 6) AS value FROM values_down", "panel", NODES, SHARES), of=tables.item_panel)
def distributed(p):
    return _down(p)[2]


@query("coherence_check", sql("""
WITH up AS (SELECT DISTINCT node, parent FROM nodes), v AS (SELECT v.node, parent, value + CASE WHEN level = 'management' AND v.node LIKE '%-1"]' THEN 1 ELSE 0 END AS value FROM values_down v JOIN up USING (node)),
c AS (SELECT parent AS node, sum(value) AS children FROM v WHERE parent <> '' GROUP BY parent)
SELECT node, round(value, 6) AS value, round(children, 6) AS children FROM v JOIN c USING (node) WHERE abs(value - children) > 1e-6""", "panel", NODES, SHARES), of=tables.item_panel)
def coherence(p):
    """Of values passed down, some of which were raised by one afterwards: these and their parents don't add up."""
    _, shares, values = _down(p)
    raised = (F.col("level") == "management") & F.col("node").endswith('-1"]')
    faulty = values.withColumn("value", F.col("value") + raised.cast("int"))
    return hierarchy.incoherent(faulty.join(shares.select("node", "parent"), "node", "left").fillna("", ["parent"]))


@query("hierarchy_metrics_groupingsets", sql("""
WITH t AS (SELECT node, level, items AS actual FROM nodes WHERE opening_date = (SELECT d FROM last_cycle)),
j AS (SELECT coalesce(t.level, v.level) AS level, coalesce(actual, 0) AS actual, value, value IS NOT NULL AS has FROM t FULL JOIN values_down v ON v.node = t.node)
SELECT level, count(*) AS n, CAST(sum(CASE WHEN has THEN 1 ELSE 0 END) AS BIGINT) AS covered, round(avg(CASE WHEN has THEN abs(actual - value) END), 6) AS mae, round(sum(CASE WHEN has THEN abs(actual - value) END) / nullif(sum(CASE WHEN has THEN actual END), 0), 6) AS wmape
FROM j GROUP BY GROUPING SETS ((), (level))""", "panel", NODES, SHARES), of=tables.item_panel)
def hierarchy_metrics(p):
    tree, _, values = _down(p)
    last = tree.agg(F.max("opening_date").alias("opening_date"))
    actual = tree.join(F.broadcast(last), "opening_date", "left_semi").select("node", F.col("level").alias("l1"), F.col("items").cast("double").alias("actual"))
    joined = actual.join(values.select("node", F.col("level").alias("l2"), "value"), "node", "full_outer").select(F.coalesce("l1", "l2").alias("level"), F.coalesce("actual", F.lit(0.0)).alias("actual"), "value")
    has, miss = F.col("value").isNotNull(), F.abs(F.col("actual") - F.col("value"))
    found = joined.groupingSets([[], ["level"]], "level").agg(F.count("*").alias("n"), F.sum(has.cast("int")).alias("covered"), F.avg(miss).alias("mae"), (F.sum(miss) / F.nullif(F.sum(F.when(has, F.col("actual"))), F.lit(0.0))).alias("wmape"))
    return found.select("level", "n", "covered", "mae", "wmape")


@query("summing_edges", sql("SELECT DISTINCT node AS leaf, a AS ancestor FROM (SELECT DISTINCT " + PATHS["city"] + " AS node, unnest([" + ", ".join(PATHS.values()) + "]) AS a FROM panel)", "panel"), of=tables.item_panel)
def summing(p):
    return hierarchy.edges(hierarchy.node_totals(p).checkpoint())


@query("nnls_reconcile", of=tables.item_panel)
def reconciled(p):
    tree, shares, values = _down(p)
    spread = tree.groupBy("node").agg(F.greatest(F.coalesce(F.stddev_samp("items"), F.lit(1.0)), F.lit(1.0)).alias("scale"))
    averages = tree.groupBy("node", "parent", "level").agg(F.avg("items").cast("double").alias("value"))
    base_rows = averages.join(values.select("node"), "node", "left_semi").join(spread, "node")
    return hierarchy.reconcile(base_rows.select(F.lit(0).cast("long").alias("fold"), "node", "parent", "level", "value", "scale"))
