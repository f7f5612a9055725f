"""ARIMA by two regressions against a slow loop."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclecast import session
from cyclecast.operators import arima


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def regress(rows):
    if not rows:
        return None, 0
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)
    return np.linalg.lstsq(x, y, rcond=None)[0], len(rows)


def state(x, p, d, q):
    """Differences, shocks and the rows of the second regression."""
    z = [None] * d + list(np.diff(x, d)) if d else list(x)
    const, long, e = ([] if d else [1.0]), p + q, [0.0] * len(x)
    lags = lambda t, n, v: [v[t - i] for i in range(1, n + 1)] if t - n >= 0 and all(v[t - i] is not None for i in range(1, n + 1)) else None
    seen = []
    for t in range(len(x)):
        own = lags(t, long, z)
        if q and own is not None and z[t] is not None:
            a, n = regress(seen)
            if n > len(const) + long:
                e[t] = z[t] - float(np.dot(a, const + own))
            seen.append([*const, *own, z[t]])
    rows = []
    for t in range(len(x)):
        zl, el = lags(t, p, z), lags(t, q, e)
        rows.append(None if zl is None or el is None or z[t] is None else [*const, *zl, *el, z[t]])
    return z, e, rows


def slow(x, p, d, q, steps=1):
    z, e, rows = state(x, p, d, q)
    b, _ = regress([r for r in rows if r])
    z, e, x, out = list(z), list(e), list(x), []
    for _ in range(steps):
        value = float(np.dot(b, ([] if d else [1.0]) + [z[-i] for i in range(1, p + 1)] + [e[-i] for i in range(1, q + 1)]))
        x.append({0: value, 1: value + x[-1], 2: value + 2 * x[-1] - x[-2]}[d])
        z.append(value), e.append(0.0), out.append(max(x[-1], 0.0))
    return out


def made(kind, n=45):
    rnd, x, e = random.Random(kind), [50.0, 55.0], [0.0, 0.0]
    for _ in range(n - 2):
        e.append(rnd.gauss(0, 5))
        x.append({"ar": 20 + 0.6 * x[-1] + e[-1], "walk": x[-1] + 0.5 * (x[-1] - x[-2]) + e[-1] + 0.4 * e[-2], "two": 30 + 0.3 * x[-1] + 0.2 * x[-2] + e[-1]}[kind])
    return x


SERIES = {k: made(k) for k in ("ar", "walk", "two")} | {"short": [1.0, 2.0, 3.0]}


def panel(spark, series):
    day = dt.date(2020, 1, 6)
    return spark.createDataFrame([(name, f"c{i:03d}", day + dt.timedelta(days=21 * i), float(v)) for name, x in series.items() for i, v in enumerate(x)], "serie string, cycle string, opening_date date, items double")


@pytest.mark.parametrize("order", [(1, 0, 0), (2, 0, 0), (1, 1, 1), (0, 1, 1), (2, 1, 2), (1, 2, 0)])
def test_matches_a_slow_version(spark, order):
    got = {(r.serie, r.step): r.predicted for r in arima.forecast(panel(spark, SERIES), *order, 4).collect()}
    want = {(name, h + 1): v for name, x in SERIES.items() if len(x) >= arima.least(*order) for h, v in enumerate(slow(x, *order, 4))}
    assert got == pytest.approx(want, rel=1e-5, abs=1e-5) and len(got) == 12
    points = arima.backtest(panel(spark, SERIES), *order, min_train=30).collect()
    assert len(points) == 3 * 15
    for r in points:
        i = int(r.cycle[1:])
        assert r.predicted == pytest.approx(slow(SERIES[r.serie][:i], *order)[0], rel=1e-5, abs=1e-5) and r.actual == SERIES[r.serie][i]


def test_constant_series_and_no_rows(spark):
    flat = panel(spark, {"zero": [0.0] * 25, "flat": [7.0] * 25})
    assert {(r.serie, r.predicted) for r in arima.forecast(flat, 1, 0, 0, 1).collect()} == {("zero", 0.0), ("flat", 7.0)}
    assert {(r.serie, r.predicted) for r in arima.forecast(flat, 1, 1, 1, 2).collect()} == {("zero", 0.0), ("flat", 7.0)}
    assert arima.backtest(flat.where(F.lit(False)), 1, 0, 0).collect() == []
    for wrong in ((0, 1, 0), (1, 3, 0), (-1, 0, 1)):
        with pytest.raises(ValueError):
            arima.backtest(flat, *wrong)
