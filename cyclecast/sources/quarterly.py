"""Quarterly tables of states: ragged wide files, and lookups by quarter with a lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def quarter_index(year: Column, quarter: Column) -> Column:
    return year * 4 + quarter - 1


def read_wide(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """``(uf, q, value)`` of a ``;`` file with title lines, a row of quarters and decimal commas.

    The header is the first line that names a quarter; rows that are no state of ``states(name, uf)``
    and cells that are no number are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "^\\x{FEFF}", ""), "\\r?\\n")).alias("line"))
    cells = lines.select(F.transform(F.split("line", ";"), lambda c: F.trim(F.regexp_replace(c, '"', ""))).alias("c"))
    header = cells.where(F.exists("c", lambda c: c.contains("trimestre") & c.rlike("\\d"))).limit(1).select(F.col("c").alias("h"))
    pairs = cells.crossJoin(F.broadcast(header)).select(F.get("c", F.lit(0)).alias("name"), F.explode(F.arrays_zip("h", "c")).alias("x"))
    year = F.regexp_extract("x.h", "(\\d)º trimestre (\\d{4})", 2)
    quarter = F.regexp_extract("x.h", "(\\d)º trimestre (\\d{4})", 1)
    tidy = pairs.where(year != "").select("name", quarter_index(year.cast("int"), quarter.cast("int")).alias("q"), F.regexp_replace("x.c", ",", ".").try_cast("double").alias("value"))
    return tidy.where("value is not null").join(F.broadcast(states), "name").select("uf", "q", "value")


def as_of(series: DataFrame, table: DataFrame, key: str, lag: int = 1) -> DataFrame:
    """``series(key, date)`` with the value of ``table(key, q, value)`` ``lag`` quarters before.

    Quarters are clamped to the key's range and gaps take the last value before them: the table is made
    dense first, so the lookup is an equi-join.
    """
    ends = table.groupBy(key).agg(F.min("q").alias("_a"), F.max("q").alias("_b"))
    grid = ends.select(key, "_a", "_b", F.explode(F.sequence("_a", "_b")).alias("q")).join(table, [key, "q"], "left")
    dense = grid.withColumn("value", F.last("value", True).over(Window.partitionBy(key).orderBy("q"))).select(key, "q", "value")
    at = quarter_index(F.year("date"), F.quarter("date")) - lag
    placed = series.join(ends, key).withColumn("q", F.greatest(F.least(at, F.col("_b")), F.col("_a"))).drop("_a", "_b")
    return placed.join(dense, [key, "q"])
