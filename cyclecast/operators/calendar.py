"""Cycles, windows and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cycle_calendar(base: DataFrame) -> DataFrame:
    """Per cycle: first opening, last closing, and whether the base covers all of it."""
    bounds = base.agg(F.min("order_date").alias("_first"), F.max("order_date").alias("_last"))
    cycles = base.groupBy("cycle").agg(F.min("opening_date").alias("opening_date"), F.max("closing_date").alias("closing_date"))
    whole = (F.col("opening_date") >= F.col("_first")) & (F.col("closing_date") <= F.col("_last"))
    return cycles.crossJoin(F.broadcast(bounds)).select("cycle", "opening_date", "closing_date", whole.alias("is_complete"))


def complete(base: DataFrame) -> DataFrame:
    """The base's rows of cycles that it covers completely."""
    known = cycle_calendar(base).where("is_complete").select("cycle")
    return base.join(F.broadcast(known), "cycle", "left_semi")


def available_calendar(base: DataFrame, as_of: str) -> DataFrame:
    """Cycles that were complete and closed before ``as_of``, told from orders before it."""
    day = F.to_date(F.lit(as_of))
    return cycle_calendar(base.where(F.col("order_date") < day)).where("is_complete").where(F.col("closing_date") < day)


def last_closed(base: DataFrame, as_of: str, cycles: int) -> DataFrame:
    return available_calendar(base, as_of).orderBy(F.desc("opening_date")).limit(cycles)


def sector_windows(base: DataFrame) -> DataFrame:
    """Each sector-cycle's own sales window."""
    windows = base.groupBy("sector", "cycle").agg(F.min("opening_date").alias("window_start"), F.max("closing_date").alias("window_end"))
    return windows.withColumn("cycle_days", F.datediff("window_end", "window_start") + 1)


def expand_days(windows: DataFrame) -> DataFrame:
    """A row per day of each window (window_start, cycle_days): offset from 0, date."""
    days = F.sequence("window_start", F.date_add("window_start", F.col("cycle_days") - 1))
    return windows.select("*", F.posexplode(days).alias("offset", "date"))


def add_business_days(day: Column, n: Column) -> Column:
    """``n`` business days on from ``day``; a weekend day first moves to Monday, which is one of them."""
    weekday = F.weekday(day)
    monday = F.date_add(day, 7 - weekday)
    ahead = lambda d, k: F.date_add(d, (k + 2 * F.floor((F.weekday(d) + k) / 5)).cast("int"))
    return F.when(weekday < 5, ahead(day, n)).otherwise(F.when(n == 0, monday).otherwise(ahead(monday, n - 1)))


def slot_start_day(block: Column, sub_block: Column) -> Column:
    return (block - 1) * 5 + sub_block


def last_targets(calendar: DataFrame, horizon: int, history: int, shift: int = 0) -> DataFrame:
    """The last complete cycles as targets (role ``target``), the ones before as ``history``."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.orderBy(F.desc("opening_date"))) - shift
    placed = calendar.where("is_complete").withColumn("back", back).where((F.col("back") > 0) & (F.col("back") <= horizon + history))
    return placed.select("cycle", "opening_date", F.when(F.col("back") <= horizon, "target").otherwise("history").alias("role"))


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian rule."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    month, day = F.floor((h + m - 7 * n + 114) / 31), (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


#: National holidays (month, day) and days from Easter.
FIXED_HOLIDAYS = ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (11, 20), (12, 25))
EASTER_HOLIDAYS = (-48, -47, -2, 60)


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """National holidays of the years, from the fixed dates and from Easter."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    fixed = [F.make_date("year", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    moving = [F.date_add(easter(F.col("year")), d) for d in EASTER_HOLIDAYS]
    return years.select(F.explode(F.array(*fixed, *moving)).alias("date")).distinct()


def working_days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Every date of the years: weekend, holiday, working day and its number in the month."""
    from pyspark.sql import Window

    day = F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31))))
    dates = spark.range(1).select(day.alias("date"))
    marked = dates.join(F.broadcast(holidays(spark, first, last).withColumn("holiday", F.lit(True))), "date", "left")
    marked = marked.select("date", F.coalesce("holiday", F.lit(False)).alias("is_holiday"), (F.weekday("date") >= 5).alias("is_weekend"))
    works = ~F.col("is_holiday") & ~F.col("is_weekend")
    number = F.sum(works.cast("int")).over(Window.partitionBy(F.trunc("date", "month")).orderBy("date"))
    return marked.select("date", "is_holiday", "is_weekend", F.when(works, number).alias("business_day"), F.coalesce(works & (number == 5), F.lit(False)).alias("is_fifth"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The ``n``-th such weekday (Monday is 0) of a month."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    return F.date_add(first, (F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1)).cast("int"))


def commercial_dates(spark: SparkSession, first: int, last: int) -> DataFrame:
    """``(name, date)``: days of much trade in the years."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    year = F.col("year")
    #: Second Sundays of May and August, the 12th of June, the day after November's fourth Thursday.
    named = {"mothers": nth_weekday(year, 5, 6, 2), "valentines": F.make_date(year, F.lit(6), F.lit(12)), "fathers": nth_weekday(year, 8, 6, 2), "black_friday": F.date_add(nth_weekday(year, 11, 3, 4), 1)}
    return years.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), d.alias("date")) for n, d in named.items()))).alias("d")).select("d.name", "d.date")


def around(dates: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each of ``dates(name, date)`` with the days before and after it: ``(name, date, offset)``."""
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")
    return dates.select("name", "date", offsets).select("name", F.date_add("date", F.col("offset")).alias("date"), "offset")


def demand_around(daily: DataFrame, dates: DataFrame) -> DataFrame:
    """Per name and offset of ``around``: how many of those days ``daily(date, items)`` has, and their mean items
    over the mean of all days."""
    mean = F.broadcast(daily.agg(F.avg("items").alias("_mean")))
    rows = daily.join(F.broadcast(dates), "date").crossJoin(mean)  # a few dates a year, and one row
    return rows.groupBy("name", "offset").agg(F.count("*").alias("n"), (F.avg("items") / F.nullif(F.first("_mean"), F.lit(0.0))).alias("lift"))
