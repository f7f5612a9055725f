"""SQL of the base tables that the counterparts of the queries start from."""

BASE = """
base_rows AS (
  SELECT CAST(o_orderdate AS DATE) AS order_date, n_name AS sector, r_name AS state, c_mktsegment AS city, r_name AS region,
    r_name || '-' || CAST(n_nationkey % 2 AS VARCHAR) AS management, CAST(100 * (1 + l_suppkey % 9) AS INTEGER) AS cd,
    l_quantity AS items, o_orderkey AS order_id, CAST(n_nationkey % 5 AS INTEGER) AS o,
    CAST(o_orderdate AS DATE) - CAST(n_nationkey % 5 AS INTEGER) AS d0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
base_cycles AS (SELECT *, year(d0) AS y, least(17, (dayofyear(d0) - 1) // 21 + 1) AS k FROM base_rows),
base AS (
  SELECT order_date, sector, state, city, region, management, cd, items, order_id, CAST(y * 100 + k AS VARCHAR) AS cycle,
    make_date(y, 1, 1) + CAST(21 * (k - 1) + o AS INTEGER) AS opening_date,
    CASE WHEN k = 17 THEN make_date(y, 12, 31) + o ELSE make_date(y, 1, 1) + CAST(21 * k - 1 + o AS INTEGER) END AS closing_date
  FROM base_cycles)"""

CALENDAR = """
calendar AS (
  SELECT cycle, min(opening_date) AS opening_date, max(closing_date) AS closing_date,
    min(opening_date) >= (SELECT min(order_date) FROM base) AND max(closing_date) <= (SELECT max(order_date) FROM base) AS is_complete
  FROM base GROUP BY cycle),
complete AS (SELECT b.* FROM base b JOIN calendar c USING (cycle) WHERE c.is_complete),
windows AS (
  SELECT sector, cycle, min(opening_date) AS window_start, max(closing_date) AS window_end,
    CAST(max(closing_date) - min(opening_date) AS INTEGER) + 1 AS cycle_days, min(region) AS region, min(management) AS management
  FROM complete GROUP BY sector, cycle)"""

PANEL = """
sums AS (
  SELECT sector, state, city, cycle, sum(items) AS items, count(DISTINCT order_id) AS orders, count(*) AS volumes
  FROM complete GROUP BY ALL),
firsts AS (SELECT sector, state, city, min(cycle) AS c1 FROM sums GROUP BY ALL),
panel AS (
  SELECT CAST(to_json([f.sector, f.state, f.city]) AS VARCHAR) AS serie, f.sector, f.state, f.city, w.cycle, coalesce(s.items, 0) AS items,
    coalesce(s.orders, 0) AS orders, coalesce(s.volumes, 0) AS volumes, c.opening_date, c.closing_date, w.window_start, w.cycle_days, w.region, w.management
  FROM windows w JOIN firsts f ON f.sector = w.sector AND w.cycle >= f.c1 JOIN calendar c ON c.cycle = w.cycle
    LEFT JOIN sums s ON s.sector = f.sector AND s.state = f.state AND s.city = f.city AND s.cycle = w.cycle)"""

DAYS = """
day_sums AS (SELECT sector, cycle, order_date AS date, sum(items) AS actual FROM complete GROUP BY ALL),
day_grid AS (
  SELECT sector, cycle, window_start, cycle_days, CAST(u.i AS INTEGER) AS "offset", window_start + CAST(u.i AS INTEGER) AS date
  FROM windows, LATERAL (SELECT unnest(range(0, cycle_days)) AS i) u),
days AS (
  SELECT g.*, coalesce(s.actual, 0) AS actual, sum(coalesce(s.actual, 0)) OVER (PARTITION BY g.sector, g.cycle) AS total_actual
  FROM day_grid g LEFT JOIN day_sums s ON s.sector = g.sector AND s.cycle = g.cycle AND s.date = g.date)"""


def sql(body: str, *parts: str) -> str:
    """``body`` after the named base tables; what follows a WITH of its own is appended to theirs."""
    known = {"base": [BASE], "calendar": [BASE, CALENDAR], "panel": [BASE, CALENDAR, PANEL], "days": [BASE, CALENDAR, DAYS]}
    chosen: list[str] = []
    for part in parts:
        chosen += [p for p in known.get(part, [part]) if p not in chosen]
    return "WITH " + ",".join(chosen) + (", " + body.strip()[5:] if body.strip().upper().startswith("WITH ") else "\n" + body)
