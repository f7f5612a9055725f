"""Order lines as a stream: totals per sector and cycle that close when no late line can reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cycle_totals(lines: DataFrame, late: str = "7 days", days: str = "21 days", origin: str = "0 days") -> DataFrame:
    """``(sector, opening, closing, items, lines)`` of ``lines(sector, order_time, items)``.

    Cycles are tumbling windows of ``days``, shifted by ``origin``. A total is final, and its state is
    dropped, once the watermark (``late`` behind the newest line) passes its end; later lines are not
    counted. State is one row per sector and open cycle, however many lines arrive.
    """
    timed = lines.withWatermark("order_time", late)
    found = timed.groupBy(F.window("order_time", days, days, origin).alias("w"), "sector").agg(F.sum("items").alias("items"), F.count("*").alias("lines"))
    return found.select("sector", F.col("w.start").alias("opening"), F.col("w.end").alias("closing"), "items", "lines")


def write_totals(totals: DataFrame, path: str, checkpoint: str):
    """Appends final totals as Parquet; what is available now is processed, then the query ends."""
    return totals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
