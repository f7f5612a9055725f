import datetime as dt

from cyclecast.streaming import orders


def test_totals_close_behind_the_watermark(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "sector string, order_time timestamp, items double").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    start = dt.datetime(2026, 1, 1)
    at = lambda days: start + dt.timedelta(days=days)
    put("a", [("S1", at(0), 2.0), ("S1", at(1), 3.0), ("S2", at(2), 7.0)])
    schema = spark.read.parquet(str(tmp_path / "in" / "a")).schema
    lines = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    totals = orders.cycle_totals(lines, late="7 days")
    run = lambda: orders.write_totals(totals, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(90)
    assert run()
    put("b", [("S1", at(90), 1.0)])  # closes the first cycles
    assert run()
    put("c", [("S2", at(1), 100.0), ("S1", at(180), 1.0)])  # too late, and closes the next
    assert run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.sector, r.items, r.lines) for r in rows) == [("S1", 1.0, 1), ("S1", 5.0, 2), ("S2", 7.0, 1)]
    assert all(r.closing - r.opening == dt.timedelta(days=21) for r in rows)
