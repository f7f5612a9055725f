"""Pooled learners: a recursive path against a slow loop, stopping, quantiles' coverage, sampled points."""

import datetime as dt
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cyclecast import session
from cyclecast.operators import calibrate, pooled

D = dt.date


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def panel(spark, series=6, cycles=30, seed=1):
    rnd, rows = random.Random(seed), []
    for s in range(series):
        for c in range(cycles):
            items = max(0.0, round(20 * (s + 1) + 5 * (c % 4) + rnd.gauss(0, 6), 3))
            opening = D(2024, 1, 1) + dt.timedelta(days=21 * c)
            rows.append((f"s{s}", f"{2024 + c // 17}{c % 17 + 1:02d}", opening, opening + dt.timedelta(days=s % 3), 20 + c % 3, items, int(items // 3) + 1, int(items // 2) + 1))
    return spark.createDataFrame(rows, "serie string, cycle string, opening_date date, window_start date, cycle_days int, items double, orders long, volumes long")


@pytest.fixture(scope="module")
def fitted(spark):
    session.checkpoints(spark)
    p = panel(spark)
    history, future = pooled.newest(p, 3)
    history, future = history.checkpoint(), future.checkpoint()
    return history, future, pooled.fit(pooled.training_rows(history).checkpoint(), most=8, depth=3)


def test_path_equals_a_slow_loop(spark, fitted):
    history, future, model = fitted
    plans = future.select("serie", "cycle", "opening_date", "window_start", "cycle_days")
    windows = plans.withColumn("scenario", F.lit("a")).unionByName(plans.withColumns({"scenario": F.lit("b"), "cycle_days": F.col("cycle_days") + 9, "window_start": F.date_add("window_start", 2)}))
    unknown = windows.limit(1).withColumn("serie", F.lit("new"))
    got = {(r.scenario, r.serie, r.cycle): r.predicted for r in pooled.path(model, history, windows.unionByName(unknown)).collect()}
    medians = model.filler.surrogateDF.first().asDict()
    past = {}
    for r in history.orderBy("opening_date").collect():
        past.setdefault(r.serie, []).append((r["items"], r.orders, r.volumes, r.window_start))
    want = {}
    for cycle in sorted({r.cycle for r in windows.collect()}):
        told = {}
        for r in windows.where(F.col("cycle") == cycle).collect():
            h = past[r.serie]
            x = [v[0] for v in h]
            level = sum(x) / len(x)
            one = {f"items_lag_{i}": x[-i] for i in (1, 2, 3, 4)} | {"items_mean_3": sum(x[-3:]) / 3, "items_mean_6": sum(x[-6:]) / 6, "level_ref": level}
            one |= {"orders_lag_1": h[-1][1], "volumes_lag_1": h[-1][2], "items_per_order_lag_1": x[-1] / h[-1][1] if h[-1][1] else None}
            one |= {"days_since_previous": (r.window_start - h[-1][3]).days, "cycle_number": int(cycle[-2:]), "cycle_days": r.cycle_days}
            vector = [medians[c] if one[c] is None else float(one[c]) for c in pooled.INPUTS] + [float(one[c] is None) for c in pooled.INPUTS]
            value = max(model.model.predict(Vectors.dense(vector)) * level, 0.0)
            want[r.scenario, r.serie, cycle] = value
            told.setdefault(r.serie, []).append((value, r.window_start))
        for serie, own in told.items():
            past[serie].append((sum(v for v, _ in own) / len(own), None, None, min(d for _, d in own)))
    assert got == pytest.approx(want) and len(got) == 36


def test_what_came_is_never_used(spark, fitted):
    history, future, model = fitted
    windows = future.select(F.lit("a").alias("scenario"), "serie", "cycle", "opening_date", "window_start", "cycle_days")
    assert pooled.path(model, history, windows.where(F.lit(False))).collect() == []
    assert "items" not in pooled.path(model, history, windows).columns


def test_boosting_stops_where_held_cycles_gain_nothing(spark):
    flat = panel(spark).withColumns({"items": F.lit(7.0), "orders": F.lit(2).cast("long"), "volumes": F.lit(2).cast("long")})
    rows = pooled.training_rows(flat).checkpoint()
    assert pooled.fit(rows, most=12, validation=4).trees < 12 and pooled.fit(rows, most=5, validation=0).trees == 5
    again = [pooled.fit(rows, most=12, validation=4).trees for _ in range(2)]
    assert again[0] == again[1]
    with pytest.raises(ValueError, match="sold before"):
        pooled.fit(rows.where(F.lit(False)))


def test_quantiles_cover_as_often_as_asked(spark):
    p = panel(spark, series=20, cycles=70, seed=4)
    found = {r.alpha: r for r in pooled.coverage(pooled.quantile_backtest(p, [0.2, 0.8], 16, rounds=8)).collect()}
    assert all(r.n == 320 and abs(r.coverage - a) < 0.06 for a, r in found.items()), found
    rows = pooled.training_rows(p).checkpoint()
    inside = {a: pooled.coverage(pooled.fit_quantile(rows, a, 8).predict(rows).withColumn("alpha", F.lit(a))).first().coverage for a in (0.2, 0.8)}
    assert all(abs(c - a) < 0.02 for a, c in inside.items())
    with pytest.raises(ValueError):
        pooled.fit_quantile(rows, 1.0)


def test_sampled_points_hit_each_stratum_once(spark):
    dims = {"temperature": (1.0, 1000.0, True), "cooling": (0.8, 0.99, False), "moves": (10.0, 20.0, False)}
    rows = calibrate.latin_hypercube(spark, 50, dims, seed=3).collect()
    import math

    assert len(rows) == 50 and len({r.point for r in rows}) == 50
    for name, (low, high, log) in dims.items():
        share = [(math.log(r[name] / low) / math.log(high / low)) if log else (r[name] - low) / (high - low) for r in rows]
        assert sorted(int(s * 50) for s in share) == list(range(50))
    assert rows == calibrate.latin_hypercube(spark, 50, dims, seed=3).collect() != calibrate.latin_hypercube(spark, 50, dims, seed=4).collect()
    with pytest.raises(ValueError):
        calibrate.latin_hypercube(spark, 5, {"x": (0.0, 1.0, True)})
