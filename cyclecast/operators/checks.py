"""Checks of inputs and results as counts: ``(check, violations)``, each set of checks one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measures that demand can be told in.
METRICS = ("items", "orders", "volumes")


def metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"unknown measure {name}; there are {METRICS}")
    return name


def row_checks(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows each condition holds for; a null is no violation."""
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in conditions))
    return counts.select(F.explode(pairs).alias("c")).select("c.check", "c.violations")


def repeated(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """How many keys stand in more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("violations")).select(F.lit(name).alias("check"), "violations")


def differing(df: DataFrame, name: str, value: Column, *keys: str) -> DataFrame:
    """How many keys have more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("violations")).select(F.lit(name).alias("check"), "violations")


def require(checks: DataFrame) -> None:
    """Raises if anything is violated."""
    found = {r.check: r.violations for r in checks.where("violations > 0").collect()}
    if found:
        raise ValueError(f"violated: {found}")


def orders(base: DataFrame) -> DataFrame:
    """Days without a time, inside their windows; items finite and not negative."""
    items = F.col("items").cast("double")
    return row_checks(base, {
        "null_dates": F.col("order_date").isNull() | F.col("opening_date").isNull() | F.col("closing_date").isNull(),
        "not_midnight": F.date_trunc("day", F.col("order_date").cast("timestamp")) != F.col("order_date").cast("timestamp"),
        "outside_window": ~F.col("order_date").between(F.col("opening_date"), F.col("closing_date")),
        "items_not_finite": items.isNull() | F.isnan(items) | (F.abs(items) == float("inf")),
        "items_negative": items < 0,
    })


def windows(planned: DataFrame) -> DataFrame:
    """Of ``planned(scenario, sector, cycle, opening_date, window_start, window_end, as_of, emit)``.

    Names and codes are well formed, days in order, windows unique, a cycle of a scenario has one opening
    and its own, emitted cycles open after ``as_of``, and all cycles have the same sectors.
    """
    found = row_checks(planned, {
        "empty_id": F.trim(F.coalesce("scenario", F.lit(""))) == "",
        "cycle_code": ~F.coalesce(F.col("cycle").rlike("^[0-9]{6}$"), F.lit(False)),
        "days_in_order": ~((F.col("opening_date") <= F.col("window_start")) & (F.col("window_start") <= F.col("window_end"))),
        "opens_before_as_of": F.col("emit") & (F.col("opening_date") <= F.col("as_of")),
    })
    found = found.unionByName(repeated(planned, "repeated_window", "scenario", "sector", "cycle"))
    found = found.unionByName(differing(planned, "several_openings", F.col("opening_date"), "scenario", "cycle"))
    found = found.unionByName(differing(planned, "shared_opening", F.col("cycle"), "scenario", "opening_date"))
    roster = planned.groupBy("scenario", "sector").agg(F.count_distinct("cycle").alias("_n"))
    cycles = planned.groupBy("scenario").agg(F.count_distinct("cycle").alias("_all"))
    short = roster.join(cycles, "scenario").agg(F.count_if(F.col("_n") < F.col("_all")).alias("violations"))
    return found.unionByName(short.select(F.lit("other_sectors").alias("check"), "violations"))


def missing_between(calendar: DataFrame, history: DataFrame, planned: DataFrame) -> DataFrame:
    """``(scenario, cycle)`` of known cycles after the history and up to a scenario's last one without a window."""
    last = history.agg(F.max("opening_date").alias("_last"))
    ends = planned.groupBy("scenario").agg(F.max("opening_date").alias("_end"))
    between = calendar.crossJoin(F.broadcast(last)).where("opening_date > _last").crossJoin(ends).where("opening_date <= _end")  # a calendar by scenarios
    return between.select("scenario", "cycle").join(planned.select("scenario", "cycle"), ["scenario", "cycle"], "left_anti")


def reused(history: DataFrame, planned: DataFrame) -> DataFrame:
    """Cycle codes that are planned and known already."""
    return history.select("cycle").intersect(planned.select("cycle"))


def hierarchy(panel: DataFrame) -> DataFrame:
    """No nulls, no negative demand, windows of a day at least, one organisation a sector, one row a series and cycle."""
    named = ("sector", "state", "city", "region", "management", "cycle", "items", "opening_date", "cycle_days")
    found = row_checks(panel, {
        "nulls": F.greatest(*(F.col(c).isNull() for c in named)), "negative_items": F.col("items") < 0, "no_days": F.col("cycle_days") < 1,
    })
    found = found.unionByName(differing(panel, "several_organizations", F.struct("region", "management"), "sector"))
    return found.unionByName(repeated(panel, "repeated_rows", "serie", "cycle"))


def node_query(query: DataFrame, history: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """A query has one cycle, a row a node, known levels; the history closed before it opens."""
    found = row_checks(query, {"unknown_level": ~F.col("level").isin(*levels)}).unionByName(repeated(query, "repeated_node", "node"))
    cycles = query.agg(F.greatest(F.count_distinct("cycle") - 1, F.lit(0)).alias("violations")).select(F.lit("several_cycles").alias("check"), "violations")
    opening = F.broadcast(query.agg(F.min("opening_date").alias("_opening")))
    late = history.crossJoin(opening).agg(F.count_if(F.col("closing_date") >= F.col("_opening")).alias("violations"))
    return found.unionByName(cycles).unionByName(late.select(F.lit("history_not_closed").alias("check"), "violations"))


def close(a: Column, b: Column) -> Column:
    """Equal but for rounding, or both null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b))


def forecast(levels: DataFrame, shapes: DataFrame, daily: DataFrame, city: tuple[str, ...]) -> DataFrame:
    """A combined forecast's parts: shares and levels are valid, days add up to the levels."""
    shares = row_checks(shapes, {"bad_share": F.isnan("share_pred") | (F.col("share_pred") < 0) | F.col("share_pred").isNull()})
    shares = shares.unionByName(repeated(shapes, "repeated_day", "path", "sector", "cycle", "date"))
    sums = shapes.groupBy("path", "sector", "cycle").agg(F.sum("share_pred").alias("_s"))
    shares = shares.unionByName(row_checks(sums, {"shares_dont_add_up": ~close(F.col("_s"), F.lit(1.0))}))
    found = shares.unionByName(row_checks(levels, {"bad_level": F.isnan("level_pred") | (F.col("level_pred") < 0)})).unionByName(repeated(levels, "repeated_level", "path", *city, "cycle"))
    totals = daily.groupBy("path", *city, "cycle").agg(F.sum("items_pred").alias("_t"))
    both = levels.select("path", *city, "cycle", "level_pred").join(totals, ["path", *city, "cycle"], "left")
    return found.unionByName(row_checks(both, {"not_conserved": ~close(F.col("_t"), F.col("level_pred"))}))


def one_each(pairs: DataFrame, member: str, group: str) -> DataFrame:
    """Members of no group or of more than one."""
    return pairs.groupBy(member).agg(F.count_distinct(group).alias("groups")).where("groups <> 1")


def sample(panel: DataFrame, count: int, seed: int) -> DataFrame:
    """The rows of ``count`` sectors chosen by a seeded hash."""
    chosen = panel.select("sector").distinct().orderBy(F.xxhash64(F.lit(seed), "sector"), "sector").limit(count)
    return panel.join(F.broadcast(chosen), "sector", "left_semi")
