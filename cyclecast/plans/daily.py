"""Queries on daily series with outside indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclecast.operators import daily
from cyclecast.plans import tables
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql
from cyclecast.session import table
from cyclecast.sources import quarterly

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of the order base summed by day and the states' quarterly values."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.order_days(spark, sf_dir), quarters(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean order value of each state and quarter, with holes; EUROPE has none."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    q = quarterly.quarter_index(F.year("o_orderdate"), F.quarter("o_orderdate"))
    found = orders.groupBy(F.col("r_name").alias("state"), q.alias("q")).agg(F.avg("o_totalprice").alias("value"))
    return found.where("state <> 'EUROPE'").withColumn("value", F.when(F.col("q") % 5 != 2, F.col("value")))


QUARTERS = """
quarters AS (SELECT state, q, CASE WHEN q % 5 <> 2 THEN v END AS value FROM (
  SELECT r_name AS state, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) WHERE state <> 'EUROPE'),
weights AS (SELECT cd, state, sum(items) / sum(sum(items)) OVER (PARTITION BY cd) AS weight FROM base GROUP BY cd, state),
indicators AS (SELECT cd, q, sum(weight * value) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) AS value FROM weights JOIN quarters USING (state) GROUP BY ALL)"""

SERIES = """
ddays AS (SELECT cd, order_date AS date, sum(items) AS y FROM base GROUP BY ALL),
iends AS (SELECT cd, min(q) AS a, max(q) AS b FROM indicators GROUP BY cd),
series AS (SELECT d.cd, d.date, d.y, d.q, i.value FROM (SELECT d.*, greatest(least(year(date) * 4 + quarter(date) - 3, b), a) AS q FROM ddays d JOIN iends USING (cd)) d ASOF LEFT JOIN (SELECT * FROM indicators WHERE value IS NOT NULL) i ON i.cd = d.cd AND i.q <= d.q),
dends AS (SELECT cd, min(date) AS a, CAST(max(date) - min(date) AS INTEGER) AS n FROM ddays GROUP BY cd),
dfolds AS (SELECT cd, f AS fold, a + CAST(179 + 30 * f AS INTEGER) AS train_end, a + CAST(209 + 30 * f AS INTEGER) AS test_end FROM (SELECT cd, a, unnest(range(0, CAST(floor((n + 1 - 210) / 30) AS BIGINT) + 1)) AS f FROM dends WHERE n + 1 >= 210))"""

SCORED = """
past AS (SELECT d.cd, fold, dayofweek(date) AS w, y FROM ddays d JOIN dfolds f ON f.cd = d.cd AND date <= train_end),
wmean AS (SELECT cd, fold, w, avg(y) AS m FROM past GROUP BY ALL), wall AS (SELECT cd, fold, avg(y) AS m FROM past GROUP BY ALL),
tests AS (SELECT d.cd, f.fold, date, CAST(date - train_end AS BIGINT) AS horizon, y FROM ddays d JOIN dfolds f ON f.cd = d.cd AND date > train_end AND date <= test_end),
dscored AS (SELECT t.*, coalesce(w.m, a.m) AS predicted FROM tests t LEFT JOIN wmean w ON w.cd = t.cd AND w.fold = t.fold AND w.w = dayofweek(t.date) JOIN wall a ON a.cd = t.cd AND a.fold = t.fold)"""
ERRORS = "count(*) AS n, round(avg(abs(predicted - y)), 6) AS mae, round(sqrt(avg((predicted - y) * (predicted - y))), 6) AS rmse, round(avg(predicted - y), 6) AS bias, round(sum(abs(predicted - y)) / nullif(sum(abs(y)), 0), 6) AS wmape"


def _scored(base: DataFrame) -> DataFrame:
    days = base.groupBy("cd", F.col("order_date").alias("date")).agg(F.sum("items").alias("y"))
    return daily.weekday_means(days, daily.folds(days))


@query("state_weights", sql("SELECT CAST(cd AS BIGINT) AS cd, state, round(weight, 6) AS weight FROM weights", "base", QUARTERS))
def state_weights(base, q):
    return daily.state_weights(base)


@query("cd_indicators", sql("SELECT CAST(cd AS BIGINT) AS cd, q, round(value, 2) AS value FROM indicators", "base", QUARTERS))
def cd_indicators(base, q):
    return rounded(daily.cd_indicators(daily.state_weights(base), q), 2)


@query("cd_series", sql("SELECT CAST(cd AS BIGINT) AS cd, date, y, q, round(value, 2) AS value FROM series", "base", QUARTERS, SERIES))
def cd_series(base, q):
    return rounded(daily.cd_series(base, daily.cd_indicators(daily.state_weights(base), q)), 2)


@query("state_features", sql("""
WITH census AS (SELECT state, count(DISTINCT city) AS cities FROM base WHERE state <> 'ASIA' GROUP BY state), m AS (SELECT state, avg(value) AS value FROM quarters GROUP BY state)
SELECT state, cities, round(value, 2) AS value FROM census FULL JOIN m USING (state)""", "base", QUARTERS))
def state_features(base, q):
    """ASIA has no census row, EUROPE no quarters."""
    census = base.where("state <> 'ASIA'").groupBy("state").agg(F.count_distinct("city").alias("cities"))
    return rounded(daily.state_features(census, q), 2)


@query("merged_quarters", sql("""
WITH o AS (SELECT state, year(order_date) * 4 + quarter(order_date) - 1 AS q, sum(items) AS items FROM base WHERE state <> 'AFRICA' GROUP BY ALL)
SELECT coalesce(o.state, k.state) AS state, coalesce(o.q, k.q) AS q, items, round(value, 2) AS value FROM o FULL JOIN quarters k ON k.state = o.state AND k.q = o.q""", "base", QUARTERS))
def merged_quarters(base, q):
    own = base.where("state <> 'AFRICA'").groupBy("state", quarterly.quarter_index(F.year("order_date"), F.quarter("order_date")).alias("q")).agg(F.sum("items").alias("items"))
    return rounded(daily.merged(own, q, "state", "q"), 2)


@query("features_by_state", sql("""
WITH m AS (SELECT state, avg(value) AS value FROM quarters GROUP BY state)
SELECT b.cycle, b.state, sum(items) AS items, round(any_value(value), 2) AS value FROM base b LEFT JOIN m USING (state) GROUP BY ALL""", "base", QUARTERS))
def features_by_state(base, q):
    rows = base.groupBy("cycle", "state").agg(F.sum("items").alias("items"))
    return rounded(daily.attach(rows, q.groupBy("state").agg(F.avg("value").alias("value"))).select("cycle", "state", "items", "value"), 2)


@query("varying_regressors", sql("""
SELECT CAST(cd AS BIGINT) AS cd, fold, r.regressor FROM (SELECT s.cd, fold, count(DISTINCT value) AS a, count(DISTINCT month(date)) AS b, count(DISTINCT year(date) // 3000) AS c FROM series s JOIN dfolds f ON f.cd = s.cd AND date <= train_end GROUP BY ALL),
  LATERAL (VALUES ('value', a), ('month', b), ('age', c)) r(regressor, n) WHERE n > 1""", "base", QUARTERS, SERIES))
def varying(base, q):
    days = daily.cd_series(base, daily.cd_indicators(daily.state_weights(base), q))
    days = days.withColumns({"month": F.month("date"), "age": F.floor(F.year("date") / 3000)})
    return daily.varying(days, daily.folds(days), ["value", "month", "age"])


@query("window_errors", sql(f"SELECT fold, {ERRORS} FROM dscored GROUP BY fold", "base", QUARTERS, SERIES, SCORED))
def window_errors(base, q):
    return daily.scored_by(_scored(base), "fold")


@query("horizon_errors", sql(f"SELECT horizon, {ERRORS} FROM dscored GROUP BY horizon", "base", QUARTERS, SERIES, SCORED))
def horizon_errors(base, q):
    return daily.scored_by(_scored(base), "horizon")


@query("residual_means", sql("""
WITH n AS (SELECT cd, date, arg_min(predicted - y, horizon) AS residual FROM dscored GROUP BY ALL)
SELECT CAST(cd AS BIGINT) AS cd, date, round(residual, 6) AS residual, round(avg(residual) OVER (PARTITION BY cd ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS residual_mean FROM n""", "base", QUARTERS, SERIES, SCORED))
def residual_means(base, q):
    return daily.residual_means(_scored(base))


MODELS = """
models AS (SELECT cd, 'weekday' AS model, y, predicted FROM dscored UNION ALL SELECT t.cd, 'mean', t.y, a.m FROM tests t JOIN wall a ON a.cd = t.cd AND a.fold = t.fold),
sums AS (SELECT cd, model, count(*) AS n, avg(y) AS mean, max(y) AS max, stddev_samp(y) AS std, avg(abs(predicted - y)) AS mae FROM models GROUP BY ALL)"""


def _models(base: DataFrame) -> DataFrame:
    days = base.groupBy("cd", F.col("order_date").alias("date")).agg(F.sum("items").alias("y"))
    windows = daily.folds(days)
    every = days.join(windows, "cd").where("date <= train_end").groupBy("cd", "fold").agg(F.avg("y").alias("predicted"))
    flat = daily.test_days(days, windows).join(every, ["cd", "fold"]).select("cd", "y", "predicted", F.lit("mean").alias("model"))
    return daily.summary(_scored(base).select("cd", "y", "predicted", F.lit("weekday").alias("model")).unionByName(flat))


@query("cd_summary", sql("SELECT CAST(cd AS BIGINT) AS cd, model, n, round(mean, 6) AS mean, max, round(std, 6) AS std, round(mae, 6) AS mae FROM sums", "base", QUARTERS, SERIES, SCORED, MODELS))
def cd_summary(base, q):
    return _models(base)


@query("cd_best_model", sql("SELECT CAST(cd AS BIGINT) AS cd, arg_min(model, mae) AS model, round(min(mae), 6) AS mae FROM sums GROUP BY cd", "base", QUARTERS, SERIES, SCORED, MODELS))
def cd_best_model(base, q):
    return daily.best_model(_models(base))
