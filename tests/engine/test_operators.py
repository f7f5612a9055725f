import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cyclecast import session
from cyclecast.operators import assign, calendar, calibrate, evaluate, features, folds, hierarchy, panel, shape
from cyclecast.sources import orders, quarterly

D = dt.date


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def base_rows():
    """Four cycles a week apart, windows of three days, one sector; MG sells 10 a day on, GO 20."""
    rows = []
    for c in range(5):
        start = D(2026, 1, 1) + dt.timedelta(days=7 * c)
        for day in range(3):
            for state, times in (("MG", 10), ("GO", 20)):
                if state == "GO" and c == 2:
                    continue
                rows.append((start + dt.timedelta(days=day), "001", state, "HOM", "r1", "g1", 100 * (1 + day % 2), float(times * (day + 1)), c * 10 + day, f"2026{c + 1:02d}", start, start + dt.timedelta(days=2)))
    return rows


SCHEMA = "order_date date, sector string, state string, city string, region string, management string, cd int, items double, order_id long, cycle string, opening_date date, closing_date date"


@pytest.fixture
def base(spark):
    return spark.createDataFrame(base_rows(), SCHEMA)


def test_panel_fills_quiet_cycles_and_separates_states(base):
    rows = {(r.serie, r.cycle): r for r in panel.item_panel(base).collect()}
    assert len(rows) == 10
    go, mg = '["001","GO","HOM"]', '["001","MG","HOM"]'
    assert rows[go, "202603"]["items"] == 0 and rows[mg, "202603"]["items"] == 60
    assert rows[go, "202601"].cycle_days == 3 and rows[go, "202601"].orders == 3


def test_partial_cycles_are_dropped(base, spark):
    cut = base.where("order_date < '2026-01-31'")
    kept = {r.cycle for r in calendar.complete(cut).select("cycle").distinct().collect()}
    assert kept == {"202601", "202602", "202603", "202604"}


def test_days_have_zeros_and_shares_of_one(base):
    days = panel.shape_days(base.where("dayofmonth(order_date) <> 2"))
    first = [r for r in days.collect() if r.cycle == "202601"]
    assert sorted(r.actual for r in first) == [0, 30, 90]
    sums = panel.shape_days(base).groupBy("cycle").agg(F.sum("actual_share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_spread_conserves_totals(base):
    days = panel.shape_days(base)
    windows = days.select("sector", "cycle", "window_start", "cycle_days").distinct()
    predictions = windows.select("sector", "cycle", F.lit(70.0).alias("items_pred"))
    found = shape.spread(predictions, windows, shape.bin_shares(days), panel.sector_cd_shares(panel.daily_base(base)))
    assert all(abs(r.s - 70) < 1e-9 for r in found.groupBy("cycle").agg(F.sum("pred").alias("s")).collect())


def test_no_history_means_a_uniform_curve(spark):
    windows = spark.createDataFrame([("x", "202601", D(2026, 1, 1), 4)], "sector string, cycle string, window_start date, cycle_days int")
    none = spark.createDataFrame([], "sector string, bin int, share double")
    assert [(r.share_pred, r.uniform_fallback) for r in shape.predict(none, windows).collect()] == [(0.25, True)] * 4


def test_latest_opening_wins(spark):
    rows = [("a", 1.0, D(2026, 1, 1)), ("a", 1.0, D(2026, 1, 3)), (None, 2.0, D(2026, 1, 2)), (None, 2.0, D(2026, 1, 1))]
    found = orders.latest_opening(spark.createDataFrame(rows, "sector string, items double, opening_date date")).collect()
    assert {(r.sector, r.opening_date.day) for r in found} == {("a", 3), (None, 2)}


def test_csv_base_keeps_ids_and_names_what_is_missing(spark, tmp_path):
    raw = pd.DataFrame({c: ["1"] for c in orders.RAW_COLUMNS} | {"cd_setor": ["001"], "data_pedido": ["2026-01-02"], "Dt Abertura": ["2026-01-01"], "Dt Fechamento": ["2026-01-03"], "extra": ["x"]})
    raw.to_csv(tmp_path / "base.csv", index=False)
    row = orders.read_orders(spark, str(tmp_path / "base.csv")).first()
    assert row.sector == "001" and row.window_days == 3 and row.order_date == D(2026, 1, 2) and "extra" not in row.asDict()
    raw.drop(columns=["CICLOS"]).to_csv(tmp_path / "bad.csv", index=False)
    with pytest.raises(ValueError, match="CICLOS"):
        orders.read_orders(spark, str(tmp_path / "bad.csv"))


def test_business_days_match_pandas(spark):
    rows = [(D(2026, 1, 1) + dt.timedelta(days=i), n) for i in range(21) for n in range(12)]
    got = spark.createDataFrame(rows, "d date, n int").select("d", "n", calendar.add_business_days(F.col("d"), F.col("n")).alias("x")).collect()
    assert all(r.x == (pd.Timestamp(r.d) + pd.offsets.BDay(r.n)).date() if r.n or r.d.weekday() < 5 else r.x.weekday() == 0 for r in got)


def test_fifth_business_day_and_easter(spark):
    rows = {r.date: r for r in calendar.working_days(spark, 2024, 2026).collect()}
    assert rows[D(2025, 4, 18)].is_holiday and rows[D(2026, 4, 3)].is_holiday and not rows[D(2026, 4, 6)].is_holiday
    assert [d for d, r in rows.items() if r.is_fifth and d.year == 2026 and d.month == 1] == [D(2026, 1, 8)]


def series(spark, values, serie="A"):
    rows = [(serie, f"{i:06d}", D(2024, 1, 1) + dt.timedelta(days=21 * i), float(v), 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "serie string, cycle string, opening_date date, items double, orders double")


def last(df, column):
    return df.select("opening_date", column.alias("x")).orderBy(F.desc("opening_date")).first().x


def last_point(points):
    found = points.orderBy(F.desc("cycle")).first()
    return found and found.predicted


def test_croston_by_hand(spark, monkeypatch):
    monkeypatch.setattr(folds, "origins", lambda panel, **_: panel.select("cycle", F.col("cycle").cast("long").alias("origin")))
    rows = series(spark, [0, 4, 0, 0, 8, 0])  # the last is the target
    size, gap = 4 + 0.1 * 4, 2 + 0.1 * (3 - 2)
    assert abs(last_point(folds.croston_backtest(rows, "classic")) - size / gap) < 1e-12
    assert abs(last_point(folds.croston_backtest(rows, "sba")) - 0.95 * size / gap) < 1e-12
    prob = 0.5
    for bought in (0, 0, 1):
        prob += 0.1 * (bought - prob)
    assert abs(last_point(folds.croston_backtest(rows, "tsb")) - prob * size) < 1e-12
    assert last_point(folds.croston_backtest(series(spark, [0, 0, 0, 5]))) == 0
    assert last_point(folds.croston_backtest(series(spark, [1, 2, 3]))) is None


def test_smoothing_by_hand(spark, monkeypatch):
    monkeypatch.setattr(folds, "origins", lambda panel, **_: panel.select("cycle", F.col("cycle").cast("long").alias("origin")))
    assert abs(last_point(folds.ses_backtest(series(spark, [10, 20, 0, 7]), 0.5)) - 7.5) < 1e-12
    assert last_point(folds.ses_backtest(series(spark, [10]), 0.5)) is None


def test_main_effects_bins_like_qcut(spark):
    for values in ([0, 0, 0, 0, 1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7], [5, 5, 5, 5, 1], [2, 9, 9, 9, 9, 9, 9]):
        rows = spark.createDataFrame([(float(v), float(i * i)) for i, v in enumerate(values)], "p double, gap double")
        got = {r.bin: (r.n_runs, round(r.gap_mean, 9)) for r in calibrate.main_effects(rows, "p").collect()}
        frame = pd.DataFrame({"p": values, "gap": [i * i for i in range(len(values))]})
        want = frame.groupby(pd.qcut(frame["p"].astype(float), 4, duplicates="drop"), observed=True)["gap"].agg(["size", "mean"])
        assert [got[k] for k in sorted(got)] == [(int(n), round(float(m), 9)) for n, m in want.to_numpy()], values


def test_rank_by_rule_picks_again_and_again(spark):
    rows = [("a", 1.0, 9.0, 2), ("b", 1.4, 5.0, 9), ("c", 1.3, 5.2, 3), ("d", 3.0, 0.0, 0), ("e", None, 1.0, 1), ("f", 1.9, 1.0, 1)]
    found = calibrate.rank_by_rule(spark.createDataFrame(rows, "config string, gap_mean double, gap_p90 double, complexity int"), 0.5)
    assert [r.config for r in found.orderBy("place").collect()] == ["c", "b", "a", "f", "d"]


def test_as_is_is_measured_from_the_cycle_start(spark):
    day = lambda n: D(2026, 3, n)
    rows = [*((f"s{i:02d}", "202603", day(2 + i % 3)) for i in range(40)), ("early", "202603", day(1)), ("late", "202603", day(30)), ("away", "202602", day(1))]
    base = spark.createDataFrame(rows, "sector string, cycle string, opening_date date")
    got = {r.sector: r.slot for r in assign.infer_as_is(base, "202603").collect()}
    assert got["early"] == 1 and got["late"] == 15 and got["s00"] == 1 and got["s02"] == 3 and got["away"] == 2


def test_features_never_see_their_own_row(spark):
    def built(final):
        return {c: v for c, v in series(spark, [1, 2, 3, 4, 5, 6, final]).select("opening_date", *features.lags([1, 2]), *features.full_means([3, 9]), features.level_ref(), *features.items_per_order_lags([1])).orderBy(F.desc("opening_date")).first().asDict().items()}

    assert built(7) == built(7000)
    assert built(7)["items_mean_3"] == 5 and built(7)["items_mean_9"] is None and built(7)["items_lag_2"] == 5


def test_common_points_and_metrics(spark):
    rows = [("a", "s", "1", 1, 10.0, 12.0), ("a", "t", "1", 1, 0.0, 1.0), ("b", "s", "1", 1, 10.0, 7.0)]
    points = spark.createDataFrame(rows, "candidate string, serie string, cycle string, origin int, actual double, predicted double").withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted")))
    table = evaluate.compare(points).collect()
    assert [(r.candidate, r.mae, r.n, r.own_points) for r in table] == [("a", 2.0, 1, 2), ("b", 3.0, 1, 1)]
    zero = points.where("serie = 't'").groupBy("candidate").agg(*evaluate.metrics()).first()
    assert zero.wmape is None and zero.bias == 1


def test_ragged_quarterly_file(spark, tmp_path):
    text = "﻿Title\nNote;x\nUF;1º trimestre 2024;2º trimestre 2024\nBrasil;9,9;9\nAcre;1,5;...\nBahia;2;3,25\n"
    (tmp_path / "q.csv").write_text(text, encoding="utf-8")
    states = spark.createDataFrame([("Acre", "AC"), ("Bahia", "BA")], "name string, uf string")
    found = {(r.uf, r.q): r.value for r in quarterly.read_wide(spark, str(tmp_path / "q.csv"), states).collect()}
    assert found == {("AC", 8096): 1.5, ("BA", 8096): 2.0, ("BA", 8097): 3.25}


def tree(spark, values):
    rows = [(0, n, p, level, float(v), 1.0) for n, p, level, v in values]
    return spark.createDataFrame(rows, "fold long, node string, parent string, level string, value double, scale double")


def test_reconciled_values_add_up_and_are_least_squares(spark):
    rng = np.random.default_rng(1)
    nodes = [("r", "", "region", 30), ("m", "r", "management", 28), ("s", "m", "sector", 33)] + [(f"c{i}", "s", "city", v) for i, v in enumerate(rng.uniform(0, 12, 5))] + [("neg", "s", "city", -9)]
    found = {r.node: r.value for r in hierarchy.reconcile(tree(spark, nodes)).collect()}
    leaves = [n for n, _, level, _ in nodes if level == "city"]
    total = sum(found[n] for n in leaves)
    assert all(abs(found[n] - total) < 1e-6 for n in "rms") and all(found[n] >= 0 for n in leaves) and found["neg"] < 1e-9
    target = {n: v for n, _, _, v in nodes}

    def cost(x):
        return sum((sum(x.values()) - target[n]) ** 2 for n in "rms") + sum((x[n] - target[n]) ** 2 for n in leaves)

    best = {n: found[n] for n in leaves}
    for n in leaves:
        for step in (1e-3, -1e-3):
            if best[n] + step >= 0:
                assert cost(best | {n: best[n] + step}) > cost(best)


def test_historical_shares_sum_to_one(spark, base):
    nodes = hierarchy.with_parent(hierarchy.with_children(hierarchy.node_totals(panel.item_panel(base))))
    shares = hierarchy.historical_shares(nodes)
    assert all(abs(r.s - 1) < 1e-9 for r in shares.groupBy("parent").agg(F.sum("share").alias("s")).collect())
    values = hierarchy.distribute(nodes.where("level = 'region'").groupBy("node").agg(F.max("items").alias("value")), shares)
    assert values.count() == 5
    assert hierarchy.incoherent(values.join(shares.select("node", "parent"), "node", "left").fillna("", ["parent"])).count() == 0


def test_two_sectors_level_out(spark):
    demand = spark.createDataFrame([(s, k + d, k, 10.0) for s in ("a", "b") for k in range(1, 16) for d in (0,)], "sector string, day int, slot int, qty double")
    as_is = spark.createDataFrame([("a", 1), ("b", 1)], "sector string, slot int")
    days = spark.createDataFrame([(1, 0), (2, 0)], "day int, cycle_no int")
    shares = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.25), ("b", 2, 0.75)], "sector string, cd int, cd_share double")
    capacity = spark.createDataFrame([(1, 11.0), (2, 7.0)], "cd int, capacity double")
    plans = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "b", 2)], "assignment_id long, sector string, slot int")
    found = {r.assignment_id: r for r in assign.evaluate(demand, plans, shares, capacity, as_is, days).collect()}
    assert (found[0].objective, found[0].churn, found[0].capacity_violation) == (20.0, 0, 2.0)
    assert (found[1].objective, found[1].churn, found[1].capacity_violation) == (0.0, 2, 0.5)
    runs = spark.createDataFrame([(i, i, 5.0, 0.99) for i in range(4)], "run long, seed long, temperature double, cooling double")
    solved = assign.anneal(spark, demand, as_is, days, runs, 400).collect()
    assert all(r.start == 20 and r.objective == 0 for r in solved)


def test_average_ranks_and_bins(spark):
    rows = spark.createDataFrame([("i", float(a), float(b)) for a, b in [(1, 5), (2, 5), (2, 9), (4, 1)]], "k string, a double, b double")
    got = calibrate.spearman(rows, "k", "a", "b").first()
    assert abs(got.rho - pd.Series([1, 2, 2, 4]).rank().corr(pd.Series([5, 5, 9, 1]).rank())) < 1e-12 and got.picked == 5 and got.oracle == 1
    runs = spark.createDataFrame([(float(p), 1.0) for p in (1, 1, 1, 2, 3, 4)], "p double, gap double")
    want = pd.qcut([1, 1, 1, 2, 3, 4], 4, duplicates="drop").codes
    assert sorted(r.n_runs for r in calibrate.main_effects(runs, "p").collect()) == sorted(np.bincount(want).tolist())


def test_weekdays_of_months_and_days_around_dates(spark):
    got = {(r.name, r.date.year): r.date.isoformat() for r in calendar.commercial_dates(spark, 2023, 2025).collect()}
    assert got["mothers", 2023] == "2023-05-14" and got["fathers", 2024] == "2024-08-11" and got["black_friday", 2024] == "2024-11-29" and got["black_friday", 2025] == "2025-11-28" and len(got) == 12
    days = {(r.offset, r.date.isoformat()) for r in calendar.around(calendar.commercial_dates(spark, 2024, 2024).where("name = 'valentines'"), 1, 2).collect()}
    assert days == {(-1, "2024-06-11"), (0, "2024-06-12"), (1, "2024-06-13"), (2, "2024-06-14")}
