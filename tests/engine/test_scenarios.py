"""Scenario answers, combined paths, checks, curves and the hierarchy's path on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cyclecast import session
from cyclecast.operators import calendar, checks, curves, daily, hierarchy, panel, scenarios

D = dt.date


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def base(spark, cycles=8, sectors=("s1", "s2"), start=D(2026, 1, 5)):
    """Cycles of seven days; sells (sector, city) k items a day, the first day twice as much."""
    rows = []
    for c in range(cycles):
        opening = start + dt.timedelta(days=7 * c)
        for s, sector in enumerate(sectors):
            for k, city in enumerate("ab"):
                for day in range(7):
                    rows.append((opening + dt.timedelta(days=day), sector, "MG", city, "r", f"g{s}", 100, float((1 + k + 2 * s) * (2 if day == 0 else 1)), c * 100 + day, f"2026{c + 1:02d}", opening, opening + dt.timedelta(days=6)))
    return spark.createDataFrame(rows, "order_date date, sector string, state string, city string, region string, management string, cd int, items double, order_id long, cycle string, opening_date date, closing_date date")


def test_windows_keep_their_answers(spark):
    asked = spark.createDataFrame([("x", "202605", D(2026, 5, d), n) for d, n in ((1, 21), (3, 21), (1, 28))], "serie string, cycle string, window_start date, cycle_days int")
    told = asked.where("cycle_days = 21").withColumn("predicted", F.dayofmonth("window_start").cast("double"))
    twice = told.withColumn("predicted", F.lit(99.0)).unionByName(told)
    found = {(r.window_start.day, r.cycle_days): r.predicted for r in scenarios.attach(asked, twice).collect()}
    assert found == {(1, 21): 1.0, (3, 21): 3.0, (1, 28): None}


def test_history_has_to_end_before_the_windows(spark):
    p = panel.item_panel(base(spark))
    with pytest.raises(ValueError, match="history reaches 2026-02-23"):
        scenarios.answer(p, p)
    history, last = p.where("cycle < '202608'"), p.where("cycle = '202608'").select(*scenarios.WINDOW, "opening_date")
    last = last.unionByName(last.limit(1).withColumn("serie", F.lit("new")))
    got = scenarios.answer(history, last).collect()
    assert {r.candidate for r in got} == set(scenarios.LEVELS) and len(got) == 5 * len(scenarios.LEVELS)
    assert {r.predicted for r in got if r.candidate == "moving_average"} == {8.0, 16.0, 24.0, 32.0, None}


def test_levels_of_a_rising_series(spark):
    rows = [("x", f"2026{i:02d}", D(2026, 1, 1) + dt.timedelta(days=30 * i), D(2026, 1, 1), n, float(3 * n)) for i, n in enumerate((10, 20, 30, 20, 40, 50))]
    history = spark.createDataFrame(rows, "serie string, cycle string, opening_date date, window_start date, cycle_days int, items double")
    asked = spark.createDataFrame([("x", "202612", D(2026, 12, 1), n, D(2026, 12, 1)) for n in (10, 40)], "serie string, cycle string, window_start date, cycle_days int, opening_date date")
    got = {(r.candidate, r.cycle_days): round(r.predicted, 6) for r in scenarios.answer(history, asked).collect()}
    assert got == {("naive:mean", 10): 85.0, ("naive:mean", 40): 85.0, ("naive:last", 10): 150.0, ("naive:last", 40): 150.0, ("moving_average", 10): 96.0, ("moving_average", 40): 96.0, ("window_scaled", 10): 30.0, ("window_scaled", 40): 120.0}


def test_replay_never_sees_its_target_and_is_exact_on_a_constant_base(spark):
    rows = base(spark)
    found = scenarios.replay(rows, panel.item_panel(rows), panel.shape_days(rows), last=2, history_cycles=3)
    got = found.collect()
    assert {r.target_cycle for r in got} == {"202607", "202608"} and len(got) == 2 * 2 * 2 * 7
    assert all(abs(r.error) < 0.5 + r.actual / 2 for r in got) and abs(sum(r.error for r in got)) < 1e-6
    doubled = rows.withColumn("items", F.when(F.col("cycle") == "202608", 2 * F.col("items")).otherwise(F.col("items")))
    other = scenarios.replay(doubled, panel.item_panel(doubled), panel.shape_days(doubled), last=2, history_cycles=3)
    key = lambda r: (r.target_cycle, r.sector, r.city, r.date)
    assert {key(r): r.items_pred for r in other.collect()} == {key(r): r.items_pred for r in got}
    total = {r.cycle: r for r in scenarios.summarize_replay(found).collect()}
    assert total["ALL"].n_scored_days == 56 and total["ALL"].actual_volume_coverage == 1 and total["ALL"].n_unpredicted_rows == 0


def test_open_cycles_become_steps_of_the_path(spark):
    late = base(spark).withColumn("closing_date", F.date_add("closing_date", 3))  # each closes after the next one opens
    cycles = calendar.cycle_calendar(late).withColumn("is_complete", F.lit(True))
    paths = scenarios.replay_paths(late, cycles, 1)
    history = scenarios.closed_history(cycles, paths.withColumn("last_order", F.col("as_of")), 3)
    assert {r.cycle for r in history.collect()} == {"202604", "202605", "202606"}
    windows = scenarios.recorded_windows(late.where("sector = 's1' or cycle <> '202607'"), cycles, paths, history)
    assert {(r.sector, r.cycle, r.emit) for r in windows.collect()} == {("s1", "202607", False), ("s1", "202608", True)}


def test_checks_count_and_raise(spark):
    rows = spark.createDataFrame([(1, -1.0), (1, 2.0), (2, None)], "k int, x double")
    found = checks.row_checks(rows, {"negative": F.col("x") < 0, "null": F.col("x").isNull()}).unionByName(checks.repeated(rows, "twice", "k"))
    assert {r.check: r.violations for r in found.collect()} == {"negative": 1, "null": 1, "twice": 1}
    with pytest.raises(ValueError, match="twice"):
        checks.require(found)
    checks.require(found.where("check = 'other'"))
    assert checks.metric("items") == "items"
    with pytest.raises(ValueError, match="unknown"):
        checks.metric("euros")
    assert checks.sample(spark.createDataFrame([(s,) for s in "abcde" * 2], "sector string"), 2, 1).count() == 4


def test_curves_know_only_earlier_cycles(spark):
    days = panel.shape_days(base(spark))
    first = {(r.cycle, r.sector, r.date): r.share_pred for r in curves.backtest(days, "b", 7, 3).collect()}
    assert len(first) == 5 * 2 * 7 and abs(first["202604", "s1", D(2026, 1, 26)] - 0.25) < 1e-9
    changed = days.withColumn("actual", F.when((F.col("cycle") == "202608") & (F.col("offset") == 3), 50.0).otherwise(F.col("actual")))
    assert {k: v for k, v in ((((r.cycle, r.sector, r.date)), r.share_pred) for r in curves.backtest(changed, "b", 7, 3).collect())} == first
    table = curves.compare(curves.backtest(days, "b", 7, 3).unionByName(curves.backtest(days, "a", 1, 3))).orderBy("place").collect()
    assert [r.candidate for r in table] == ["b", "a"] and table[0].share_mae_pp < 1e-9


def test_learned_curves_add_up_and_find_the_first_day(spark):
    days = panel.shape_days(base(spark, sectors=("s1",)))
    windows = spark.createDataFrame([("s1", "202609", D(2026, 3, 2), 7), ("new", "202609", D(2026, 3, 2), 7)], "sector string, cycle string, window_start date, cycle_days int")
    found = curves.learned(days, windows, 10).collect()
    for sector in ("s1", "new"):
        shares = {r.offset: r.share_pred for r in found if r.sector == sector}
        assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) == 0


def test_a_path_feeds_on_its_own_forecasts(spark):
    p = panel.item_panel(base(spark)).withColumn("items", F.col("items").cast("double")).checkpoint()
    history, ahead = p.where("cycle <= '202605'"), p.where("cycle > '202605'")
    found = hierarchy.forecast_path(history, ahead.drop("items", "orders", "volumes"))
    got = {(r.serie, r.cycle): r.level_pred for r in found.collect()}
    want = {(r.serie, r.cycle): r["items"] for r in ahead.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)  # a constant base goes on
    nodes = hierarchy.forecast_cycle(history, ahead.where("cycle = '202606'").drop("items", "orders", "volumes"))
    parents = hierarchy.node_totals(p).select("node", "parent").distinct()
    assert hierarchy.incoherent(nodes.join(parents, "node").select("node", "parent", "value")).count() == 0


def test_scores_keep_both_sides(spark):
    told = spark.createDataFrame([("a", "city", 3.0), ("b", "city", 1.0)], "node string, level string, value double")
    came = spark.createDataFrame([("a", "city", 5.0), ("c", "region", 0.0)], "node string, level string, items double")
    got = {r.node: (r.value, r.actual, r.has_prediction, r.active) for r in hierarchy.score(told, came).collect()}
    assert got == {"a": (3.0, 5.0, True, True), "b": (1.0, 0.0, True, False), "c": (None, 0.0, False, True)}


def test_expanding_windows_are_whole(spark):
    days = spark.createDataFrame([(1, D(2026, 1, 1) + dt.timedelta(days=i), float(i % 7), 5 if i < 190 else 6) for i in range(245)], "cd int, date date, y double, x int")
    windows = daily.folds(days)
    assert [(r.fold, (r.train_end - D(2026, 1, 1)).days) for r in windows.orderBy("fold").collect()] == [(0, 179), (1, 209)]
    assert [(r.fold, r.regressor) for r in daily.varying(days, windows, ["x"]).collect()] == [(1, "x")]
    told = daily.weekday_means(days, windows)
    assert told.count() == 60 and told.agg(F.max("horizon")).first()[0] == 30 and all(abs(r.predicted - r.y) < 1e-9 for r in told.collect())
