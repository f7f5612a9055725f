"""The tables that queries share: right where keys repeat, and cut into more tasks as the lines grow."""

import duckdb
import pytest

from cyclecast import session
from cyclecast.plans import catalog, tables
from cyclecast.sources import orders
from tests.engine.test_queries import plain


@pytest.fixture(scope="module")
def star(tmp_path_factory):
    """Orders of two years; some keys are there twice: in the same cycle, in another, with another customer."""
    folder = tmp_path_factory.mktemp("star")
    con = duckdb.connect()
    day = "TIMESTAMP '1998-01-01' + to_days(CAST((k * 37) % 760 AS INTEGER))"
    bought = f"SELECT k AS o_orderkey, k % 40 AS o_custkey, {day} AS o_orderdate FROM range(900) t(k)"
    write = {
        "region": "SELECT CAST(k AS INTEGER) AS r_regionkey, 'R' || k AS r_name FROM range(3) t(k)",
        "nation": "SELECT CAST(k AS INTEGER) AS n_nationkey, 'N' || k AS n_name, CAST(k % 3 AS INTEGER) AS n_regionkey FROM range(7) t(k)",
        "customer": "SELECT k AS c_custkey, CAST(k % 7 AS INTEGER) AS c_nationkey, 'S' || (k % 2) AS c_mktsegment FROM range(40) t(k)",
        "orders": f"{bought} UNION ALL SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 1 DAY FROM ({bought}) WHERE o_orderkey % 9 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 60 DAY FROM ({bought}) WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderdate FROM ({bought}) WHERE o_orderkey % 13 = 0 AND o_custkey < 39",
        "lineitem": "SELECT k % 950 AS l_orderkey, k % 31 AS l_suppkey, CAST(CASE WHEN k % 17 > 0 THEN k % 50 END AS DOUBLE) AS l_quantity FROM range(2600) t(k)",
    }
    for name, rows in write.items():
        con.sql(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["item_panel", "item_panel_by_sector", "demand_level", "demand_shape", "daily_base", "cd_shares", "projected_demand", "daily_capacity"])
@pytest.mark.parametrize("task_bytes", [orders.TASK_BYTES, 500])
def test_repeated_keys(spark, star, monkeypatch, name, task_bytes):
    session.checkpoints(spark)
    monkeypatch.setattr(orders, "TASK_BYTES", task_bytes)
    tables.forget()
    found = catalog.QUERIES[name](spark, star)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    con = duckdb.connect()
    for table in tables.SOURCES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{star}/{table}.parquet'")
    answer = con.sql(catalog.ORACLE_SQL[name])
    at = [answer.columns.index(c) for c in columns]
    tables.forget()
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=str)


def test_tasks_grow_with_the_lines(spark, star, monkeypatch):
    monkeypatch.setattr(orders, "TASK_BYTES", 500)
    lines = orders._lines_of_star(spark, star)
    assert lines.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
