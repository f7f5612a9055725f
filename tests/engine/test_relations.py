"""Checked joins, equality of tables, paths up a tree, and the choice of a level and a curve."""

import datetime as dt

import pytest

from cyclecast import session
from cyclecast.operators import choice, relations

D = dt.date


@pytest.fixture(autouse=True)
def folder(spark):
    session.checkpoints(spark)


def test_join_to_one_fails_on_a_repeated_key_that_is_asked_for(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10.0), (3, 30.0), (3, 31.0), (None, 5.0)], "k int, v double")
    assert sorted(map(tuple, relations.to_one(left, right, ["k"]).collect()), key=str) == [(1, "a", 10.0), (1, "b", 10.0), (2, "c", None), (None, "d", None)]
    assert relations.to_one(left, right, ["k"], "inner").count() == 2
    with pytest.raises(Exception, match="several rows on the right for k=3"):
        relations.to_one(left.union(spark.createDataFrame([(3, "e")], "k int, x string")), right, ["k"]).collect()
    with pytest.raises(ValueError):
        relations.to_one(left, right, ["k"], "full")


def test_differences_count_repeats_and_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "k int, s string")
    b = spark.createDataFrame([(None, 1), ("x", 2), ("z", 3)], "s string, k int")
    assert sorted(map(tuple, relations.differences(a, b).collect()), key=str) == [(1, None, 1), (3, "y", 1), (3, "z", -1)]
    assert relations.differences(a, a.orderBy("k")).isEmpty()
    with pytest.raises(ValueError, match="columns differ"):
        relations.differences(a, b.withColumnRenamed("s", "t"))


def test_layouts_tell_what_is_moved_missing_unknown_and_repeated(spark):
    observed = spark.createDataFrame([(s, D(2026, 1, d), D(2026, 1, d + 5)) for s, d in (("a", 1), ("b", 2), ("c", 3))], "sector string, window_start date, window_end date")
    rows = [("same", s, D(2026, 1, d), D(2026, 1, d + 5)) for s, d in (("c", 3), ("a", 1), ("b", 2))]
    rows += [("bad", "a", D(2026, 1, 2), D(2026, 1, 6)), ("bad", "b", D(2026, 1, 2), D(2026, 1, 7)), ("bad", "b", D(2026, 1, 2), D(2026, 1, 7)), ("bad", "x", D(2026, 1, 1), None)]
    found = {r.layout: r for r in relations.layout_checks(observed, spark.createDataFrame(rows, "layout string, sector string, window_start date, window_end date"), "layout", "sector").collect()}
    same, bad = found["same"], found["bad"]
    assert same.same and (same.n_missing, same.n_unknown, same.n_repeated, same.n_surplus, same.n_lacking) == (0, 0, 0, 0, 0)
    assert not bad.same and (bad.n_missing, bad.n_unknown, bad.n_repeated, bad.n_surplus, bad.n_lacking) == (1, 1, 1, 3, 2)


def test_ancestors_at_any_depth(spark):
    parents = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(21)] + [("leaf", "n3"), ("other", ""), ("leaf2", "other")]
    found = {(r.node, r.ancestor): r.depth for r in relations.ancestors(spark.createDataFrame(parents, "node string, parent string")).collect()}
    want = {(f"n{i}", f"n{j}"): i - j for i in range(21) for j in range(i)} | {("leaf", f"n{j}"): 4 - j for j in range(4)} | {("leaf2", "other"): 1}
    assert found == want
    for rows, text in (([("a", "b"), ("b", "c"), ("c", "a")], "its own ancestor"), ([("a", "a")], "its own ancestor"), ([("a", "b"), ("a", "c")], "two parents"), ([(f"x{i}", f"x{(i + 1) % 7}") for i in range(7)], "its own ancestor")):
        with pytest.raises(ValueError, match=text):
            relations.ancestors(spark.createDataFrame(rows, "node string, parent string"))
    assert relations.ancestors(spark.createDataFrame([("a", None)], "node string, parent string")).isEmpty()


def test_pairs_outer_join_days_and_break_ties_by_name(spark):
    totals = spark.createDataFrame([("s", f"c{i}", i, float(v)) for i, v in enumerate((10, 10, 40, 20), 1)], "sector string, cycle string, origin int, total double")
    levels = choice.sector_levels(totals, 1)
    assert {(r.level, r.value) for r in levels.collect()} == {("last", 40.0), ("mean", 20.0), ("mean_5", 20.0)}
    curves = spark.createDataFrame([("flat", "s", "c4", D(2026, 1, d), 0.5) for d in (1, 2)] + [("first", "s", "c4", D(2026, 1, 1), 1.0)], "curve string, sector string, cycle string, date date, share_pred double")
    actual = spark.createDataFrame([(D(2026, 1, 1), 10.0), (D(2026, 1, 2), 10.0), (D(2026, 1, 3), 0.0)], "date date, actual double")
    found = choice.pairs(levels, curves, actual)
    rows = {(r.level, r.curve): r for r in found.collect()}
    assert len(rows) == 6 and all(r.n_days == 3 for r in rows.values())
    assert rows["mean", "flat"].wmape == 0 and rows["mean", "flat"].place == 1 and rows["mean_5", "flat"].place == 2
    assert rows["last", "first"].wmape == pytest.approx((30 + 10) / 20) and choice.best(found).first().level == "mean"
