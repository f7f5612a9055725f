"""Queries on the order base: calendar, panels, shares, days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclecast.operators import calendar, panel
from cyclecast.plans import tables
from cyclecast.plans.sqlbase import sql
from cyclecast.sources.orders import latest_opening, orders_of_star, unmatched

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2000-07-01"


def query(name: str, oracle: str | None = None, of=tables.order_days):
    """Registers a function of the order base summed by day, or of another table."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(of(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts as long, so that sums in another order compare as equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


@query("order_base", sql("SELECT order_date, sector, state, city, region, management, CAST(cd AS BIGINT) AS cd, items, order_id, cycle, opening_date, closing_date FROM base", "base"), of=orders_of_star)
def order_base(base):
    return rounded(base)


@query("defan_latest_opening", sql("""
WITH fan AS (SELECT * FROM base UNION ALL SELECT * REPLACE (CAST(opening_date - 1 AS DATE) AS opening_date) FROM base WHERE cd = 100),
kept AS (SELECT sector, cycle, order_id, cd, state, city, region, management, order_date, items, closing_date, max(opening_date) AS opening_date FROM fan GROUP BY ALL)
SELECT sector, cycle, opening_date, count(*) AS n, round(sum(items), 6) AS items FROM kept GROUP BY ALL""", "base"), of=orders_of_star)
def defan(base):
    fan = base.union(base.where("cd = 100").withColumn("opening_date", F.date_sub("opening_date", 1)).select(base.columns))
    return rounded(latest_opening(fan).groupBy("sector", "cycle", "opening_date").agg(F.count("*").alias("n"), F.sum("items").alias("items")))


@query("cycle_calendar", sql("SELECT cycle, opening_date, closing_date, is_complete FROM calendar", "calendar"))
def cycles(base):
    return calendar.cycle_calendar(base)


@query("available_calendar", sql(f"""
WITH past AS (SELECT * FROM base WHERE order_date < DATE '{AS_OF}'),
cal AS (SELECT cycle, min(opening_date) AS opening_date, max(closing_date) AS closing_date FROM past GROUP BY cycle)
SELECT cycle, opening_date, closing_date, TRUE AS is_complete FROM cal
WHERE opening_date >= (SELECT min(order_date) FROM past) AND closing_date <= (SELECT max(order_date) FROM past) AND closing_date < DATE '{AS_OF}'
ORDER BY opening_date DESC LIMIT 20""", "base"))
def available(base):
    return calendar.last_closed(base, AS_OF, 20)


@query("item_panel", sql("SELECT serie, sector, state, city, cycle, items, orders, volumes, opening_date, closing_date, window_start, CAST(cycle_days AS BIGINT) AS cycle_days, region, management FROM panel", "panel"), of=tables.item_panel)
def item_panel(p):
    return rounded(p)


@query("item_panel_by_sector", sql("""
WITH own AS (SELECT sector, cycle, sum(items) AS items, count(DISTINCT order_id) AS orders, count(*) AS volumes FROM complete GROUP BY ALL)
SELECT CAST(to_json([o.sector]) AS VARCHAR) AS serie, o.sector, o.cycle, o.items, o.orders, o.volumes, c.opening_date, c.closing_date, w.window_start, CAST(w.cycle_days AS BIGINT) AS cycle_days, w.region, w.management
FROM own o JOIN windows w USING (sector, cycle) JOIN calendar c ON c.cycle = o.cycle""", "calendar"), of=tables.sector_panel)
def by_sector(p):
    return rounded(p)


@query("sector_windows", sql("SELECT sector, cycle, window_start, window_end, CAST(cycle_days AS BIGINT) AS cycle_days FROM windows", "calendar"))
def sector_windows(base):
    return rounded(calendar.sector_windows(calendar.complete(base)))


@query("organization_conflicts", sql("SELECT sector, cycle, count(DISTINCT region) AS regions, count(DISTINCT management) AS managements FROM base GROUP BY ALL HAVING count(DISTINCT region) > 1 OR count(DISTINCT management) > 1", "base"))
def conflicts(base):
    return panel.conflicting_organization(base)


@query("sector_cycle_attributes", sql("""
WITH c AS (SELECT sector, cycle, cd, sum(items) AS items FROM base GROUP BY ALL),
r AS (SELECT sector, cycle, max(region) AS region, max(management) AS management FROM base GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY sector, cycle ORDER BY items DESC, cd DESC) AS place FROM c)
SELECT t.sector, t.cycle, CAST(t.cd AS BIGINT) AS cd, r.region, r.management FROM t JOIN r USING (sector, cycle) WHERE place = 1""", "base"))
def attributes(base):
    return rounded(panel.sector_cycle_attributes(base))


@query("shape_panel", sql("""
WITH p AS (SELECT sector, cycle, CAST(order_date - opening_date + 1 AS DOUBLE) / CAST(closing_date - opening_date + 1 AS DOUBLE) AS relative_position, sum(items) AS items FROM complete GROUP BY ALL)
SELECT sector, cycle, round(relative_position, 6) AS relative_position, round(items, 6) AS items, round(items / sum(items) OVER (PARTITION BY sector, cycle), 6) AS share FROM p""", "calendar"))
def shape_panel(base):
    return rounded(panel.shape_panel(base))


@query("daily_base", sql("SELECT sector, CAST(cd AS BIGINT) AS cd, cycle, order_date AS date, sum(items) AS items FROM complete GROUP BY ALL", "calendar"))
def daily(base):
    return rounded(panel.daily_base(base))


@query("shape_days", sql("""SELECT sector, cycle, date, window_start, CAST(cycle_days AS BIGINT) AS cycle_days, CAST("offset" AS BIGINT) AS "offset", actual, total_actual, round(actual / nullif(total_actual, 0), 6) AS actual_share FROM days""", "days"))
def shape_days(base):
    return rounded(panel.shape_days(base))


@query("demand_level", sql("SELECT sector, cycle, min(order_date) AS date, CAST(max(closing_date) - min(opening_date) + 1 AS BIGINT) AS cycle_duration, sum(items) AS items, count(DISTINCT order_id) AS orders, count(*) AS volumes FROM base GROUP BY ALL", "base"), of=orders_of_star)
def demand_level(base):
    return rounded(panel.demand_level(base))


@query("demand_shape", sql("""
WITH s AS (SELECT sector, cycle, order_date, min(CAST(order_date - opening_date AS DOUBLE) / CAST(closing_date - opening_date + 1 AS DOUBLE)) AS relative_date, sum(items) AS items, count(DISTINCT order_id) AS orders, count(*) AS volumes
  FROM base WHERE CAST(order_date - opening_date AS DOUBLE) / CAST(closing_date - opening_date + 1 AS DOUBLE) <= 1 GROUP BY sector, cycle, order_date)
SELECT sector, cycle, order_date, round(relative_date, 6) AS relative_date, items, orders, volumes, round(items / sum(items) OVER w, 6) AS share_items,
  round(orders / sum(orders) OVER w, 6) AS share_orders, round(volumes / sum(volumes) OVER w, 6) AS share_volumes FROM s WINDOW w AS (PARTITION BY sector, cycle)""", "base"), of=orders_of_star)
def demand_shape(base):
    return rounded(panel.demand_shape(base))


@query("cd_shares", sql("WITH s AS (SELECT sector, cd, sum(items) AS items FROM complete GROUP BY ALL) SELECT sector, CAST(cd AS BIGINT) AS cd, round(items / sum(items) OVER (PARTITION BY sector), 6) AS cd_share FROM s", "calendar"))
def cd_shares(base):
    return rounded(panel.sector_cd_shares(panel.daily_base(base)))


@query("recent_cd_shares", sql(f"""
WITH past AS (SELECT * FROM base WHERE order_date < DATE '{AS_OF}'),
cal AS (SELECT cycle, min(opening_date) AS opening_date, max(closing_date) AS closing_date FROM past GROUP BY cycle),
last AS (SELECT cycle FROM cal WHERE opening_date >= (SELECT min(order_date) FROM past) AND closing_date <= (SELECT max(order_date) FROM past) AND closing_date < DATE '{AS_OF}' ORDER BY opening_date DESC LIMIT 6),
r AS (SELECT sector, cd, sum(items) AS items FROM past WHERE cycle IN (SELECT cycle FROM last) GROUP BY ALL),
f AS (SELECT sector, cd, sum(items) AS items FROM past WHERE sector NOT IN (SELECT sector FROM r) GROUP BY ALL),
u AS (SELECT * FROM r UNION ALL SELECT * FROM f)
SELECT sector, CAST(cd AS BIGINT) AS cd, round(items / sum(items) OVER (PARTITION BY sector), 6) AS cd_share FROM u""", "base"))
def recent_shares(base):
    return rounded(panel.recent_cd_shares(base, AS_OF))


@query("dominant_cd", sql("WITH s AS (SELECT sector, cd, sum(items) AS items FROM base GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY items DESC, cd) AS place FROM s) SELECT sector, CAST(cd AS BIGINT) AS cd FROM r WHERE place = 1", "base"))
def dominant_cd(base):
    return rounded(panel.dominant_cd(base))


@query("items_per_order", sql("WITH l AS (SELECT sector, cycle, sum(items) AS items, count(DISTINCT order_id) AS orders FROM base GROUP BY ALL) SELECT sector, round(sum(items) / sum(orders), 6) AS items_per_order FROM l GROUP BY sector", "base"), of=orders_of_star)
def items_per_order(base):
    return rounded(panel.items_per_order(panel.demand_level(base)))


@query("unmatched_calendar", sql("WITH d AS (SELECT DISTINCT sector, cycle FROM base) SELECT sector, cycle FROM d WHERE cycle NOT IN (SELECT cycle FROM calendar WHERE is_complete)", "calendar"))
def unmatched_calendar(base):
    return unmatched(base.select("sector", "cycle").distinct(), calendar.sector_windows(calendar.complete(base)))


@query("cycle_spacing", sql("WITH c AS (SELECT opening_date, opening_date - lag(opening_date) OVER (ORDER BY opening_date) AS gap FROM calendar WHERE is_complete) SELECT CAST(quantile_cont(gap, 0.5) AS BIGINT) AS spacing FROM c", "calendar"))
def cycle_spacing(base):
    from pyspark.sql import Window

    gaps = calendar.cycle_calendar(base).where("is_complete").select(F.datediff("opening_date", F.lag("opening_date").over(Window.orderBy("opening_date"))).alias("gap"))
    return gaps.agg(F.percentile("gap", F.lit(0.5)).cast("long").alias("spacing"))


@query("last_targets", sql("""
WITH p AS (SELECT cycle, opening_date, row_number() OVER (ORDER BY opening_date DESC) AS back FROM calendar WHERE is_complete)
SELECT cycle, opening_date, CASE WHEN back <= 3 THEN 'target' ELSE 'history' END AS role FROM p WHERE back <= 23""", "calendar"))
def last_targets(base):
    return calendar.last_targets(calendar.cycle_calendar(base), 3, 20)


@query("national_sector_city_totals", sql("SELECT sector, city, sum(items) AS items, CAST(grouping(sector) * 2 + grouping(city) AS BIGINT) AS level FROM complete GROUP BY GROUPING SETS ((), (sector), (sector, city))", "calendar"))
def totals(base):
    found = calendar.complete(base).groupingSets([[], ["sector"], ["sector", "city"]], "sector", "city").agg(F.sum("items").alias("items"), F.grouping_id().alias("level"))
    return rounded(found.select("sector", "city", "items", "level"))


@query("top_cities", sql("WITH s AS (SELECT sector, city, sum(items) AS items FROM base GROUP BY ALL) SELECT sector, city, items FROM s ORDER BY items DESC, sector, city LIMIT 20", "base"))
def top_cities(base):
    return base.groupBy("sector", "city").agg(F.sum("items").alias("items")).orderBy(F.desc("items"), "sector", "city").limit(20)


@query("crosstab_cd_routes", sql("SELECT sector, " + ", ".join(f"count(*) FILTER (cd = {100 * i}) AS cd_{100 * i}" for i in range(1, 10)) + " FROM base GROUP BY sector", "base"), of=orders_of_star)
def crosstab(base):
    counts = base.groupBy("sector").pivot("cd", [100 * i for i in range(1, 10)]).agg(F.count(F.lit(1)))
    return counts.select("sector", *(F.coalesce(str(100 * i), F.lit(0)).alias(f"cd_{100 * i}") for i in range(1, 10)))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_days(spark, sf_dir).select("order_date").distinct()


def business_day_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _days(spark, sf_dir).crossJoin(spark.range(0, 15).select(F.col("id").cast("int").alias("n")))
    return starts.select("order_date", F.col("n").cast("long").alias("n"), calendar.add_business_days(F.col("order_date"), F.col("n")).alias("date"))


QUERIES["business_day_map"] = business_day_map
ORACLE_SQL["business_day_map"] = sql("""
WITH d AS (SELECT DISTINCT order_date FROM base), n AS (SELECT unnest(range(0, 15)) AS n),
s AS (SELECT order_date, n, CASE WHEN isodow(order_date) <= 5 THEN order_date ELSE order_date + CAST(8 - isodow(order_date) AS INTEGER) END AS b,
  CASE WHEN isodow(order_date) <= 5 OR n = 0 THEN n ELSE n - 1 END AS k FROM d, n)
SELECT order_date, n, b + CAST(k + 2 * ((isodow(b) - 1 + k) // 5) AS INTEGER) AS date FROM s""", "base")


def _years(base: DataFrame) -> tuple[int, int]:
    span = base.agg(F.year(F.min("order_date")).alias("a"), F.year(F.max("order_date")).alias("b")).first()
    return span.a, span.b


@query("demand_around_dates", sql("""
WITH y AS (SELECT unnest(range(year(min(order_date)), year(max(order_date)) + 1)) AS y FROM base),
d AS (SELECT 'mothers' AS name, make_date(y, 5, 1) + CAST((6 - (isodow(make_date(y, 5, 1)) - 1) + 7) % 7 + 7 AS INTEGER) AS date FROM y UNION ALL SELECT 'valentines', make_date(y, 6, 12) FROM y UNION ALL
  SELECT 'fathers', make_date(y, 8, 1) + CAST((6 - (isodow(make_date(y, 8, 1)) - 1) + 7) % 7 + 7 AS INTEGER) FROM y UNION ALL SELECT 'black_friday', make_date(y, 11, 1) + CAST((3 - (isodow(make_date(y, 11, 1)) - 1) + 7) % 7 + 22 AS INTEGER) FROM y),
a AS (SELECT name, date + CAST(o AS INTEGER) AS date, CAST(o AS BIGINT) AS "offset" FROM d, (VALUES (-1), (0), (1)) v(o)),
t AS (SELECT order_date AS date, CAST(sum(items) AS DOUBLE) AS items FROM base GROUP BY order_date)
SELECT name, "offset", count(*) AS n, round(avg(items) / (SELECT avg(items) FROM t), 6) AS lift FROM t JOIN a USING (date) GROUP BY ALL""", "base"))
def demand_around_dates(base):
    """Demand on commercial dates and the days beside them."""
    daily = base.groupBy(F.col("order_date").alias("date")).agg(F.sum("items").cast("double").alias("items"))
    return rounded(calendar.demand_around(daily, calendar.around(calendar.commercial_dates(base.sparkSession, *_years(base)))))


def holiday_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the years that the orders span."""
    return rounded(calendar.working_days(spark, *_years(tables.order_days(spark, sf_dir))))


QUERIES["holiday_flags"] = holiday_flags
ORACLE_SQL["holiday_flags"] = """
WITH e(d) AS (VALUES (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'), (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15')),
f(m, k) AS (VALUES (1,1),(4,21),(5,1),(9,7),(10,12),(11,2),(11,15),(11,20),(12,25)),
h AS (SELECT make_date(year(d), m, k) AS date FROM e, f UNION SELECT d + o FROM e, (VALUES (-48), (-47), (-2), (60)) x(o)),
span AS (SELECT make_date(min(year(o_orderdate)), 1, 1) AS a, make_date(max(year(o_orderdate)) + 1, 1, 1) AS b FROM orders),
days AS (SELECT CAST(unnest(range(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
m AS (SELECT date, date IN (SELECT date FROM h) AS is_holiday, isodow(date) > 5 AS is_weekend FROM days),
n AS (SELECT *, CASE WHEN NOT is_holiday AND NOT is_weekend THEN sum(CASE WHEN NOT is_holiday AND NOT is_weekend THEN 1 ELSE 0 END) OVER (PARTITION BY date_trunc('month', date) ORDER BY date) END AS b FROM m)
SELECT date, is_holiday, is_weekend, CAST(b AS BIGINT) AS business_day, coalesce(b = 5, FALSE) AS is_fifth FROM n"""
