"""The hierarchy's back-tests on a small tree."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cyclecast import session
from cyclecast.operators import hierarchy, nodefolds

D = dt.date


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def rows(cycles=12, gap=0, last=None):
    """Cycles of seven days; each closes ``gap`` days after the next one opens. City a of s1 sells c a cycle, b 2c,
    s2 only in even cycles 10; s3 opens in the last cycle."""
    out = []
    for c in range(1, cycles + 1):
        opening = D(2026, 1, 5) + dt.timedelta(days=7 * c)
        closing = opening + dt.timedelta(days=6 + gap)
        sold = {("s1", "a"): float(c), ("s1", "b"): 2.0 * c, ("s2", "a"): 10.0 if c % 2 == 0 else 0.0} | ({("s3", "z"): 7.0} if c == cycles else {})
        for (sector, city), items in sold.items():
            if c == cycles and last is not None:
                items = last
            out.append(("r", "g1" if sector == "s1" else "g2", sector, "MG", city, f"{sector}|{city}", f"2026{c:02d}", items, opening, closing, opening, 7))
    return out


def known(spark, **options):
    panel = spark.createDataFrame(rows(**options), "region string, management string, sector string, state string, city string, serie string, cycle string, items double, opening_date date, closing_date date, window_start date, cycle_days int")
    nodes = hierarchy.node_totals(panel).checkpoint()
    return nodefolds.with_closed_state(hierarchy.with_parent(hierarchy.with_children(nodes))).checkpoint()


def test_states_end_with_what_had_closed(spark):
    for gap, back in ((0, 1), (1, 2), (8, 3)):
        found = known(spark, gap=gap).where("level = 'city' and node like '%\"s1\",\"MG\",\"a\"%'").collect()
        assert {r.cycle: (r.state.lag_1 if r.state else None) for r in found} == {f"2026{c:02d}": float(c - back) if c > back else None for c in range(1, 13)}
        assert all(r.closed == max(r.idx - back, 0) for r in found)


def test_forecasts_by_hand(spark):
    nodes = known(spark)
    told = {(r.candidate, r.cycle, r.node): r.value for r in nodefolds.forecasts(nodes, min_closed=6).collect()}
    city = '["r","g1","s1","MG","%s"]'
    assert told["direct_ma_5", "202609", city % "a"] == pytest.approx(6.0)
    # of the cycles 4 to 8: 90 of 120 are g1's; of all, 108 of 148
    weight = 5 / (5 + nodefolds.PRIOR)
    g1 = 90 / 120 * weight + 108 / 148 * (1 - weight)
    assert told["topdown_ma_5", "202609", '["r"]'] == pytest.approx(24.0)
    assert told["topdown_ma_5", "202609", '["r","g1"]'] == pytest.approx(24 * g1)
    assert told["topdown_ma_5", "202609", city % "b"] == pytest.approx(24 * g1 * 2 / 3)
    assert ("direct_ma_5", "202612", '["r","g2","s3"]') not in told and not any(c < "202607" for _, c, _ in told)


def test_all_candidates_add_up_and_never_see_their_target(spark):
    nodes, other = known(spark), known(spark, last=500.0)
    found = {}
    for name, of in (("as it was", nodes), ("another last cycle", other)):
        told = nodefolds.forecasts(of, 6, 1).unionByName(nodefolds.learned_distribution(of, "202612", trees=3, depth=2))
        found[name] = {(r.candidate, r.node): r.value for r in told.collect()}
    assert found["as it was"] == pytest.approx(found["another last cycle"])
    values = found["as it was"]
    assert {c for c, _ in values} == {"direct_ma_5", "topdown_ma_5", "topdown_ets", "topdown_ets_learned"}
    for name in ("topdown_ma_5", "topdown_ets", "topdown_ets_learned"):
        leaves = sum(v for (c, n), v in values.items() if c == name and n.count(",") == 4)
        assert leaves == pytest.approx(values[name, '["r"]']) and leaves > 0


def test_learned_shares_of_siblings_are_one(spark):
    found = nodefolds.learned_shares(known(spark), "202612", trees=5, depth=2)
    sums = {r.parent: r.s for r in found.groupBy("parent").agg(F.sum("share").alias("s")).collect()}
    assert set(sums) == {'["r"]', '["r","g1"]', '["r","g2"]', '["r","g1","s1"]', '["r","g2","s2"]'} and all(s == pytest.approx(1) for s in sums.values())
    shares = {r.node: r.share for r in found.collect()}
    assert shares['["r","g1","s1","MG","b"]'] == pytest.approx(2 / 3, abs=0.05) and shares['["r","g2","s2"]'] == 1
    with pytest.raises(ValueError, match="nothing is known"):
        nodefolds.learned_shares(known(spark), "202712")


def test_nothing_to_learn_gives_the_fallback(spark):
    rows = nodefolds.feature_rows(known(spark).where("level = 'city'"))
    query = rows.where("cycle = '202612'")
    got = nodefolds.learned(rows.where("idx < 0"), query).collect()
    want = {r.node: r.s for r in query.select("node", nodefolds.historical_score().alias("s")).collect()}
    assert {r.node: r.score for r in got} == want
    volume = {r.node: r.score for r in nodefolds.learned(rows.where("idx < 12"), query, "volume", trees=3, depth=2).collect()}
    assert set(volume) == set(want) and all(v >= 0 for v in volume.values())


def test_summary_counts_the_unknown_and_both_scopes(spark):
    nodes = known(spark)
    points = nodefolds.scored(nodes, nodefolds.forecasts(nodes, 6), 6)
    found = {(r.scope, r.candidate, r.level): r for r in nodefolds.summary(points).collect()}
    every, active = found["all", "direct_ma_5", "city"], found["active", "direct_ma_5", "city"]
    assert (every.n_points, every.n_nodes, every.n_missing) == (19, 4, 1) and active.n_points == 16  # s2 is quiet in 7, 9 and 11
    assert every.coverage_volume_pct == pytest.approx(100 * (1 - 7 / (3 * sum(range(7, 13)) + 30 + 7)))
    by_cycle = nodefolds.summary(points, "cycle")
    assert by_cycle.where("scope = 'all' and level = 'region' and candidate = 'topdown_ets'").count() == 6
