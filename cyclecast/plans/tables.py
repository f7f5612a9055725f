"""The tables that many queries start from, made once for a session, a folder and the state of its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from cyclecast.operators import panel
from cyclecast.sources.orders import city_days_of_star, file_states, order_days_of_star, orders_of_star

#: By application, folder and name: the state of the files, and the table made from them.
_KEPT: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}
SOURCES = ("lineitem", "orders", "customer", "nation", "region")


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make`` gives, kept on the executors, and made again where a part is lost.

    Where the source tables' files have changed since, it is made anew and the old one dropped; ``forget`` drops all.
    """
    key = spark.sparkContext.applicationId, sf_dir, name
    state = tuple(f for source in SOURCES for f in file_states(spark, sf_dir, source))
    known = _KEPT.get(key)
    if known and known[0] != state:
        known[1].unpersist()
        known = None
    if not known:
        spark.catalog.refreshByPath(sf_dir)
        known = _KEPT[key] = state, make().persist(StorageLevel.MEMORY_AND_DISK)
    return known[1]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order base summed by day, for all that reads it more than once and doesn't count lines or orders."""
    return _kept(spark, sf_dir, "order_days", lambda: order_days_of_star(spark, sf_dir))


def item_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item panel, from the lines summed by city and day."""
    return _kept(spark, sf_dir, "item_panel", lambda: panel.item_panel(_kept(spark, sf_dir, "city_days", lambda: city_days_of_star(spark, sf_dir))))


def sector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel by sector alone."""
    return panel.item_panel(orders_of_star(spark, sf_dir), by_city=False, dates=order_days(spark, sf_dir))


def forget() -> None:
    """Drops the tables that are kept."""
    while _KEPT:
        _KEPT.popitem()[1][1].unpersist()
