"""Queries on pooled learners. Fits have no SQL; tests hold them against slow loops and held-out cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.operators import pooled
from cyclecast.plans import tables
from cyclecast.plans.backtests import INDEX
from cyclecast.plans.panels import rounded
from cyclecast.plans.sqlbase import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AHEAD = 3


def query(name: str, oracle: str | None = None):
    """Registers a function of the item panel."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(tables.item_panel(spark, sf_dir)), 6)
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


def scenarios(future: DataFrame) -> DataFrame:
    """The windows as they came, and a week longer."""
    rows = future.select("serie", "cycle", "opening_date", "window_start", F.col("cycle_days").cast("int").alias("cycle_days"))
    return rows.withColumn("scenario", F.lit("as planned")).unionByName(rows.withColumns({"scenario": F.lit("longer"), "cycle_days": F.col("cycle_days") + 7}))


@query("gbt_path")
def gbt_path(p):
    """The last three cycles from those before them, each from the forecasts of the one before."""
    history, future = pooled.newest(p, AHEAD)
    model = pooled.fit(pooled.training_rows(history).checkpoint(), most=30)
    return pooled.path(model, history, scenarios(future)).select("scenario", "serie", "cycle", "window_start", F.col("cycle_days").cast("long").alias("cycle_days"), "predicted")


@query("gbt_early_stopping")
def early_stopping(p):
    """How many trees the last four cycles ask for, and the error on the last three of all, not learnt from."""
    history, future = pooled.newest(p, AHEAD)
    model = pooled.fit(pooled.training_rows(history).checkpoint(), most=40)
    test = pooled.training_rows(p).join(F.broadcast(future.select("cycle").distinct()), "cycle", "left_semi")
    found = model.predict(test).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    return found.select(F.lit(model.trees).cast("long").alias("trees"), "n", "mae")


@query("quantile_coverage")
def quantile_coverage(p):
    """Of the last twelve cycles."""
    return pooled.coverage(pooled.quantile_backtest(p, [0.1, 0.5, 0.9], 12))


@query("series_state", sql(f"""
WITH x AS (SELECT serie, cycle, opening_date, CAST(items AS DOUBLE) AS items, CAST(orders AS DOUBLE) AS orders, CAST(volumes AS DOUBLE) AS volumes, window_start, row_number() OVER (PARTITION BY serie ORDER BY opening_date DESC) AS b FROM panel JOIN idx USING (cycle, opening_date) WHERE i <= (SELECT max(i) - 3 FROM idx))
SELECT serie, round(sum(items) FILTER (b <= 3) / nullif(count(*) FILTER (b <= 3), 0), 6) AS newest_mean, round(sum(items), 6) AS total, count(*) AS n, arg_min(window_start, b) AS last_start, arg_min(orders, b) AS orders, arg_min(volumes, b) AS volumes FROM x GROUP BY serie""", "panel", INDEX))
def state(p):
    """What the first of the three cycles is forecast from."""
    history, _ = pooled.newest(p, AHEAD)
    newest = F.slice("recent", 1, 3)
    return pooled.series_state(history).select("serie", (F.aggregate(newest, F.lit(0.0), lambda a, x: a + x) / F.size(newest)).alias("newest_mean"), "total", "n", "last_start", "orders", "volumes")
