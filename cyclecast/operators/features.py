"""Features of the cycles before a row, in one window per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def of_series(key: str = "serie") -> WindowSpec:
    return Window.partitionBy(key).orderBy("opening_date")


def before(spec: WindowSpec, rows: int | None = None) -> WindowSpec:
    """The last ``rows`` rows before the current one; None: all."""
    return spec.rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def lags(names: list[int], column: str = "items") -> list[Column]:
    return [F.lag(column, n).over(of_series()).alias(f"{column}_lag_{n}") for n in names]


def full_means(windows: list[int]) -> list[Column]:
    """Means of the last w rows, null before there are so many."""
    spec = of_series()
    return [F.when(F.count("items").over(before(spec, w)) == w, F.avg("items").over(before(spec, w))).alias(f"items_mean_{w}") for w in windows]


def level_ref() -> Column:
    return F.avg("items").over(before(of_series())).alias("level_ref")


def items_per_order_lags(names: list[int]) -> list[Column]:
    ratio = F.try_divide(F.col("items"), F.col("orders"))
    return [F.lag(ratio, n).over(of_series()).alias(f"items_per_order_lag_{n}") for n in names]


def window_features() -> list[Column]:
    previous = F.lag("window_start").over(of_series())
    return [previous.alias("previous_start"), F.datediff("window_start", previous).alias("days_since_previous"), F.dayofmonth("window_start").alias("opening_day_of_month")]


def calendar_features() -> list[Column]:
    return [F.right("cycle", F.lit(2)).cast("int").alias("cycle_number"), F.month("opening_date").alias("cycle_month"), F.quarter("opening_date").alias("cycle_quarter")]


def momentum() -> list[Column]:
    """Of built features: last change, and last value against the mean of three (0: null)."""
    return [
        (F.col("items_lag_1") - F.col("items_lag_2")).alias("momentum"),
        F.try_divide(F.col("items_lag_1"), F.nullif("items_mean_3", F.lit(0.0))).alias("momentum_ratio"),
    ]


def build(panel: DataFrame, lag: list[int] = (1, 2, 3, 4), mean: list[int] = (3, 6)) -> DataFrame:
    """All features of the panel: one shuffle and one sort by series."""
    return panel.select(
        "*", *lags(list(lag)), *full_means(list(mean)), level_ref(), *lags([1], "orders"), *lags([1], "volumes"),
        *items_per_order_lags([1]), *window_features(), *calendar_features(),
    )


def trainable(features: DataFrame, required: list[str], ratio_target: bool = False) -> DataFrame:
    rows = features.dropna(subset=required)
    return rows.where("level_ref > 0") if ratio_target else rows


def closed_before(nodes: DataFrame, key: str = "serie") -> DataFrame:
    """Per row, how many of its series' cycles had closed before it opened, and the last one's items.

    Openings and closings are one ordered stream of events per series; on one day openings come first,
    as a cycle that closes that day hasn't closed before it.
    """
    none = F.lit(None)
    opens = nodes.select(key, "cycle", F.col("opening_date").alias("_at"), F.lit(0).alias("_kind"), none.cast("double").alias("_items"), "opening_date")
    closes = nodes.select(key, none.cast("string").alias("cycle"), F.col("closing_date").alias("_at"), F.lit(1).alias("_kind"), F.col("items").cast("double").alias("_items"), none.cast("date").alias("opening_date"))
    so_far = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = opens.unionByName(closes).withColumns({"n_closed": F.count("_items").over(so_far), "last_closed_items": F.last("_items", True).over(so_far)})
    return seen.where("_kind = 0").select(key, "cycle", "opening_date", "n_closed", "last_closed_items")
