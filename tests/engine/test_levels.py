import datetime as dt

import numpy as np
import pytest

from cyclecast import session
from cyclecast.operators import levels, paths

D = dt.date


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


@pytest.fixture
def totals(spark):
    """S1 rises by 10, S2 falls to 0, S3 has one cycle only."""
    rows = [("S1", i + 1, 10.0 * (i + 1)) for i in range(4)] + [("S2", i + 1, 30.0 - 10 * i) for i in range(4)] + [("S3", 4, 7.0)]
    return spark.createDataFrame(rows, "sector string, cycle_id long, cycle_total double")


def of(df):
    return {(r.sector, r.cycle_id): round(r.forecast_cycle_total, 6) for r in df.collect()}


def test_last_and_trend(totals):
    assert of(levels.naive_last(totals, [1, 2])) == {("S1", 5): 40, ("S1", 6): 40, ("S2", 5): 0, ("S2", 6): 0, ("S3", 5): 7, ("S3", 6): 7}
    assert of(levels.linear_trend(totals, [1, 2])) == {("S1", 5): 50, ("S1", 6): 60, ("S2", 5): 0, ("S2", 6): 0, ("S3", 5): 7, ("S3", 6): 7}


def test_calendar_regression_is_least_squares(spark):
    rng = np.random.default_rng(1)
    opens = [D(2025, 1, 10) + dt.timedelta(days=21 * i) for i in range(20)]
    y = rng.uniform(10, 90, 18)
    totals = spark.createDataFrame([("A", i + 1, float(v)) for i, v in enumerate(y)], "sector string, cycle_id long, cycle_total double")
    cycles = spark.createDataFrame([(i + 1, o) for i, o in enumerate(opens)], "cycle_id long, open_date date")
    x = np.array([(1, i + 1, o.month) for i, o in enumerate(opens)], float)
    beta = np.linalg.lstsq(x[:18], y, rcond=None)[0]
    got = of(levels.calendar_regression(totals, cycles, [1, 2]))
    assert got == {("A", 19): pytest.approx(x[18] @ beta, abs=1e-5), ("A", 20): pytest.approx(x[19] @ beta, abs=1e-5)}


def test_fits_per_sector(totals):
    got = of(levels.fitted_per_sector(totals, "holt", levels.smoothed, [1, 2]))
    assert got["S1", 5] == pytest.approx(50) and got["S1", 6] == pytest.approx(60) and got["S2", 5] == 0 and got["S3", 6] == 7
    assert levels.differenced_autoregression(np.array([1.0, 3, 4, 4.5, 4.75]), [1, 2]) == pytest.approx([4.875, 4.9375])
    assert levels.differenced_autoregression(np.array([5.0]), [1]) == [5]


def test_scoreboard_places_the_best_first(spark, totals):
    actual = spark.createDataFrame([("S1", 5, 50.0), ("S2", 5, 0.0)], "sector string, cycle_id long, cycle_total double")
    both = levels.naive_last(totals, [1]).unionByName(levels.linear_trend(totals, [1]))
    rows = {r.strategy: r for r in levels.scoreboard(both, actual).collect()}
    assert rows["linear_trend"].place == 1 and rows["linear_trend"].mae == 0
    assert rows["naive_last"].mae == 5 and rows["naive_last"].bias == -5 and rows["naive_last"].wmape == pytest.approx(0.2)


def test_path_feeds_its_own_results(spark):
    rows = [("a", D(2026, 1, 1 + i), float(x)) for i, x in enumerate((9, 1, 2, 3))] + [("b", D(2026, 1, 1), 4.0)]
    panel = spark.createDataFrame(rows, "serie string, opening_date date, items double")
    got = {}
    for r in paths.moving_average_path(panel, 3, 3).collect():
        got.setdefault(r.serie, {})[r.step] = r.predicted
    first, second = 2.0, (2 + 3 + 2) / 3
    assert got["a"] == pytest.approx({1: first, 2: second, 3: (3 + first + second) / 3})
    assert got["b"] == {1: 4, 2: 4, 3: 4}
    assert paths.moving_average_path(panel.limit(0), 3, 3).count() == 0


def test_best_of_k_and_gaps(spark):
    runs = spark.createDataFrame([(5.0, 1.0), (4.0, 2.0), (3.0, 6.0), (2.0, 9.0)], "forecast_to_be double, realized_improvement_pct double")
    got = {r.k: r.mean_improvement_pct for r in paths.best_of_k(runs, [1, 4, 5], draws=400).collect()}
    assert set(got) == {1, 4} and got[4] == 9 and got[1] == pytest.approx(4.5, abs=0.7)
    gaps = spark.createDataFrame([(110.0, 100.0), (50.0, 0.0), (50.0, None)], "objective double, lower_bound double")
    rows = paths.certified_gap(gaps).collect()
    assert rows[0].vs_optimum == pytest.approx(0.1) and rows[0].vs_incumbent == pytest.approx(10 / 110)
    assert rows[1].vs_optimum is None and rows[1].vs_incumbent == 1 and rows[2].vs_incumbent is None
    assert tuple(paths.model_size(spark.createDataFrame([(10,)], "sectors long"), spark.createDataFrame([(21,), (21,)], "d long"), 15, 9).first()) == (150, 4, 10 + 84 + 9 * 42 + 1)


def test_ablation_effects_on_common_points(spark):
    rows = [("a", D(2026, 1, 1 + i), float(x)) for i, x in enumerate((1, 2, 4, 8))]
    panel = spark.createDataFrame(rows, "serie string, opening_date date, items double")
    got = {r.variant: r for r in paths.leave_one_out(panel, {"lag_1": 1, "lag_2": 2}).collect()}
    assert got["full"].mae == pytest.approx((2.5 + 5) / 2) and got["full"].effect == 0
    assert got["without lag_2"].mae == pytest.approx((2 + 4) / 2) and got["without lag_1"].effect == pytest.approx(4.5 - 3.75)
