"""Panels by series and cycle, by day, and by position in the window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclecast.operators import calendar

SERIES = ("sector", "state", "city")


def serie(*columns: str) -> Column:
    """The names as a JSON list: nulls and names that hold a separator stay apart."""
    return F.to_json(F.array(*columns))


def _counted(rows: DataFrame, *keys: str, **others: Callable[[str], Column]) -> DataFrame:
    """Items, orders and lines by ``keys``, and ``others``: columns with their least or greatest values.

    Lines are summed by order first, where a join by orders has left them; only sums move on. Rows without
    ``order_id`` are sums already, whose ``orders`` no two share.
    """
    if "order_id" not in rows.columns:
        return rows.groupBy(*keys).agg(*(f(c).alias(c) for c, f in others.items()), *(F.sum(c).alias(c) for c in ("items", "orders", "volumes")))
    each = rows.groupBy("order_id", *keys).agg(F.sum("items").alias("items"), F.count("*").alias("volumes"), *(f(c).alias(c) for c, f in others.items()))
    return each.groupBy(*keys).agg(*(f(c).alias(c) for c, f in others.items()), F.sum("items").alias("items"), F.count("order_id").alias("orders"), F.sum("volumes").alias("volumes"))


def item_panel(base: DataFrame, by_city: bool = True, dates: DataFrame | None = None) -> DataFrame:
    """A row per series and complete cycle: items, orders, volumes, dates, window, organisation.

    A city is quiet, not missing, in later cycles that its sector was active in: an equi-join on the
    sector with the cities known by then, filled with zeros. The calendar, the windows and the
    organisation are aggregates of the same base; Spark joins them by broadcast as they are small. They
    are read from ``dates``, the base summed by day, where that is at hand.
    """
    dates = base if dates is None else dates
    cycles = calendar.cycle_calendar(dates)
    whole = F.broadcast(cycles.where("is_complete").select("cycle"))
    rows = base.join(whole, "cycle", "left_semi")
    days = cycles.select("cycle", F.col("opening_date").alias("cycle_opening"), F.col("closing_date").alias("cycle_closing"))
    own = dates.join(whole, "cycle", "left_semi").groupBy("sector", "cycle").agg(
        F.min("opening_date").alias("window_start"), F.max("closing_date").alias("window_end"),
        F.min("region").alias("region"), F.min("management").alias("management"),
    )
    keys = [*SERIES] if by_city else ["sector"]
    sums = _counted(rows, *keys, "cycle")
    if by_city:
        first = sums.groupBy(*SERIES).agg(F.min("cycle").alias("_first"))
        grid = own.select("sector", "cycle").join(first, "sector").where(F.col("cycle") >= F.col("_first")).drop("_first")
        sums = grid.join(sums, [*SERIES, "cycle"], "left").fillna(0, ["items", "orders", "volumes"])
    joined = sums.join(own, ["sector", "cycle"]).join(F.broadcast(days), "cycle")
    return joined.select(
        serie(*keys).alias("serie"), *keys, "cycle", "items", "orders", "volumes", F.col("cycle_opening").alias("opening_date"),
        F.col("cycle_closing").alias("closing_date"), "window_start", (F.datediff("window_end", "window_start") + 1).alias("cycle_days"), "region", "management",
    )


def conflicting_organization(base: DataFrame) -> DataFrame:
    """Sector-cycles with more than one region or management."""
    found = base.groupBy("sector", "cycle").agg(F.count_distinct("region").alias("regions"), F.count_distinct("management").alias("managements"))
    return found.where("regions > 1 or managements > 1")


def dominant(base: DataFrame, column: str) -> DataFrame:
    """Each sector-cycle's value with the most items; of equal ones the largest."""
    sums = base.groupBy("sector", "cycle", column).agg(F.sum("items").alias("_items"))
    return sums.groupBy("sector", "cycle").agg(F.max_by(column, F.struct("_items", column)).alias(column))


def sector_cycle_attributes(base: DataFrame) -> DataFrame:
    found = base.select("sector", "cycle").distinct()
    for column in ("cd", "region", "management"):
        found = found.join(dominant(base, column), ["sector", "cycle"], "left")
    return found


def shape_panel(base: DataFrame) -> DataFrame:
    """Per sector, complete cycle and relative position: items and their share of the cycle."""
    position = (F.datediff("order_date", "opening_date") + 1) / (F.datediff("closing_date", "opening_date") + 1)
    sums = calendar.complete(base).groupBy("sector", "cycle", position.alias("relative_position")).agg(F.sum("items").alias("items"))
    return sums.withColumn("share", F.col("items") / F.sum("items").over(Window.partitionBy("sector", "cycle")))


def daily_base(base: DataFrame) -> DataFrame:
    """Items per sector, CD, complete cycle and date with orders."""
    rows = calendar.complete(base)
    return rows.groupBy("sector", "cd", "cycle", F.col("order_date").alias("date")).agg(F.sum("items").alias("items"))


def shape_days(base: DataFrame) -> DataFrame:
    """Every day of each complete sector-cycle window: items (0 without orders), total, share (null if 0)."""
    rows = calendar.complete(base)
    days = calendar.expand_days(calendar.sector_windows(rows).drop("window_end"))
    sums = rows.groupBy("sector", "cycle", F.col("order_date").alias("date")).agg(F.sum("items").alias("actual"))
    total = F.sum("actual").over(Window.partitionBy("sector", "cycle"))
    days = days.join(sums, ["sector", "cycle", "date"], "left").fillna(0.0, ["actual"]).withColumn("total_actual", total)
    return days.withColumn("actual_share", F.col("actual") / F.nullif("total_actual", F.lit(0.0)))


def demand_level(base: DataFrame) -> DataFrame:
    """Per sector and cycle: first date, duration, and the three sums."""
    sums = _counted(base, "sector", "cycle", order_date=F.min, opening_date=F.min, closing_date=F.max)
    duration = (F.datediff("closing_date", "opening_date") + 1).alias("cycle_duration")
    return sums.select("sector", "cycle", F.col("order_date").alias("date"), duration, "items", "orders", "volumes")


def demand_shape(base: DataFrame) -> DataFrame:
    """Per sector, cycle and date: relative date (at most 1), sums over CDs, shares of the cycle's totals."""
    relative = F.datediff("order_date", "opening_date") / (F.datediff("closing_date", "opening_date") + 1)
    rows = base.withColumn("relative_date", relative).where("relative_date <= 1")
    sums = _counted(rows, "sector", "cycle", "order_date", relative_date=F.min)
    of_cycle = Window.partitionBy("sector", "cycle")
    return sums.select("*", *((F.col(c) / F.nullif(F.sum(c).over(of_cycle), F.lit(0))).alias(f"share_{c}") for c in ("items", "orders", "volumes")))


def sector_cd_shares(actuals: DataFrame) -> DataFrame:
    """Each sector's share of items by CD."""
    sums = actuals.groupBy("sector", "cd").agg(F.sum("items").alias("items"))
    return sums.select("sector", "cd", (F.col("items") / F.sum("items").over(Window.partitionBy("sector"))).alias("cd_share"))


def recent_cd_shares(base: DataFrame, as_of: str, cycles: int = 6) -> DataFrame:
    """CD shares over the last cycles closed before ``as_of``; of sectors quiet then, over all before it."""
    before = base.where(F.col("order_date") < F.to_date(F.lit(as_of)))
    recent = sector_cd_shares(before.join(F.broadcast(calendar.last_closed(base, as_of, cycles).select("cycle")), "cycle", "left_semi"))
    rest = sector_cd_shares(before).join(recent.select("sector").distinct(), "sector", "left_anti")
    return recent.unionByName(rest)


def dominant_cd(base: DataFrame) -> DataFrame:
    """Each sector's CD with the most items; of equal ones the smallest."""
    sums = base.groupBy("sector", "cd").agg(F.sum("items").alias("_items"))
    return sums.groupBy("sector").agg(F.max_by("cd", F.struct("_items", -F.col("cd"))).alias("cd"))


def items_per_order(level: DataFrame) -> DataFrame:
    return level.groupBy("sector").agg((F.sum("items") / F.nullif(F.sum("orders"), F.lit(0))).alias("items_per_order"))
