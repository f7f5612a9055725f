"""Smoothing with trend and season against a slow loop."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cyclecast import session
from cyclecast.operators import smoothing
from cyclecast.operators.smoothing import Form


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def slow(form, x, steps):
    """The forecasts of the setting that fits x best."""
    best = None
    for alpha, beta, phi, gamma in form.settings:
        m = form.period
        if m:
            level = sum(x[:m]) / m
            season = [v - level if form.season == "add" else v / level for v in x[:m]]
            trend = (sum(x[m : 2 * m]) - sum(x[:m])) / m / m if form.trend else 0.0
        else:
            level, trend, season = x[0], x[1] - x[0] if form.trend else 0.0, []
        square = logs = n = 0.0
        for y in x[m or 1 :]:
            base = level + phi * trend
            f = base + season[0] if form.season == "add" else base * season[0] if season else base
            e = y - f
            own, seasonal = (e / season[0], e / base) if form.season == "mul" else (e, e)
            weighed = e if form.error == "add" else e / max(abs(f), 1e-3)
            square, logs, n = square + weighed**2, logs + math.log(max(abs(f), 1e-3)), n + 1
            level, trend = base + alpha * own, phi * trend + beta * own
            season = season[1:] + [season[0] + gamma * seasonal] if season else []
        misfit = square if form.error == "add" else n * math.log(max(square, 1e-12)) + 2 * logs
        if best is None or round(misfit, 6) < best[0]:
            out = []
            for h in range(1, steps + 1):
                f = level + trend * sum(phi**i for i in range(1, h + 1))
                now = season[(h - 1) % m] if m else None
                out.append(max(f + now if form.season == "add" else f * now if m else f, 0.0))
            best = round(misfit, 6), out
    return best[1]


def panel(spark, series):
    day = dt.date(2020, 1, 6)
    rows = [(name, f"c{i:03d}", day + dt.timedelta(days=21 * i), float(v), 20 + i % 3) for name, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "serie string, cycle string, opening_date date, items double, cycle_days int")


SERIES = {"rising": [10 + 3 * i + (i * 7) % 5 for i in range(30)], "falling": [90 - 4 * i for i in range(30)], "seasonal": [(40 + i) * (1 + 0.5 * (i % 4 == 0)) for i in range(30)], "noise": [random.Random(i).randint(1, 50) for i in range(30)], "short": [3, 4, 9]}
FORMS = [Form(), Form(trend="add"), Form(trend="add", damped=True), Form(error="mul", trend="add"), Form(season="add", period=4), Form(trend="add", season="mul", period=4), Form(error="mul", trend="add", damped=True, season="mul", period=4), Form(season="mul", period=3)]


@pytest.mark.parametrize("form", FORMS, ids=lambda f: f.name)
def test_forecasts_match_a_slow_loop(spark, form):
    got = {(r.serie, r.step): r.predicted for r in smoothing.forecast(panel(spark, SERIES), form, 6).collect()}
    want = {(name, h + 1): v for name, x in SERIES.items() if len(x) >= form.least for h, v in enumerate(slow(form, x, 6))}
    assert got == pytest.approx(want) and ("short", 1) not in got


def test_each_origin_is_fitted_on_what_came_before(spark):
    form = Form(trend="add", damped=True)
    points = smoothing.backtest(panel(spark, SERIES), form, min_train=5).collect()
    assert len(points) == 4 * 22 and {r.candidate for r in points} == {"ets(A,Ad,N)"}
    for r in points:
        i = int(r.cycle[1:])
        assert r.predicted == pytest.approx(slow(form, SERIES[r.serie][:i], 1)[0]) and r.actual == SERIES[r.serie][i]


def test_names_least_and_nonsense():
    assert [(f.name, f.least) for f in FORMS[:5]] == [("ets(A,N,N)", 4), ("ets(A,A,N)", 6), ("ets(A,Ad,N)", 8), ("ets(M,A,N)", 6), ("ets(A,N,A,4)", 8)]
    for wrong in ({"damped": True}, {"season": "add"}, {"period": 4}, {"error": "x"}, {"trend": "mul"}):
        with pytest.raises(ValueError):
            Form(**wrong)


def test_shared_weights_match_a_slow_loop(spark):
    alphas, exponents = tuple(i / 20 for i in range(1, 21)), (0.0, 0.5, 1.0)
    p = panel(spark, SERIES)
    best = None
    for a in alphas:
        for e in exponents:
            error, levels = 0.0, {}
            for name, x in SERIES.items():
                scale = [(20 + i % 3) ** e for i in range(len(x))]
                level = x[0] / scale[0]
                for v, s in list(zip(x, scale))[1:]:
                    error += abs(v / s - level) * s
                    level += a * (v / s - level)
                levels[name] = level
            if best is None or round(error, 6) < best[0]:
                best = round(error, 6), a, e, levels
    r = smoothing.shared_choice(smoothing.shared_levels(p, alphas, exponents), alphas).first()
    assert (r.alpha, r.exponent) == best[1:3] and r.error == pytest.approx(best[0])
    windows = spark.createDataFrame([("rising", 10), ("rising", 40), ("unknown", 21)], "serie string, cycle_days int")
    got = {(w.serie, w.cycle_days): w.predicted for w in smoothing.shared_forecast(p, windows, alphas, exponents).collect()}
    assert got["unknown", 21] is None and got["rising", 40] == pytest.approx(best[3]["rising"] * 40 ** best[2])
    assert smoothing.backtest(p.where(F.lit(False)), Form()).collect() == []
