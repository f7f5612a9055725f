"""Registered queries against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from cyclecast import session
from cyclecast.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SOME = ("item_panel", "defan_latest_opening", "shape_days", "recent_cd_shares", "closed_history_asof", "cycle_factor_backtest", "croston", "ets_fixed_alpha", "compare_candidates", "days_exponent", "shape_recency", "combined_daily", "node_children", "distribute_topdown", "assignment_eval", "qcut_effects", "quarter_asof_join", "business_day_map", "infer_as_is", "rank_rule", "log_sigma_band", "naive_scale_mase", "opening_factors", "croston_tsb", "errors_by_state",
        "naive_last_backtest", "naive_mean_backtest", "naive_seasonal_backtest", "moving_average_backtest", "window_scaled_backtest", "item_panel_by_sector", "scenario_forecast", "align_predictions",
        "hierarchy_backtest", "closed_state", "ets_trend_damped", "ets_relative_errors", "ets_seasonal", "ets_pooled_grid", "arima_200_backtest", "arima_111_backtest", "pick_level_shape", "scenario_layouts", "ancestor_paths",
        "series_state", "order_checks", "hierarchy_checks", "coherence_check")
#: Those that one scale factor alone would not tell wrong.
BOTH = ("naive_seasonal_backtest", "cycle_factor_backtest", "window_scaled_backtest", "item_panel_by_sector")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return round(float(value), 5) + 0.0
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize(("name", "sf"), [*((n, SF) for n in SOME), *((n, SF.replace("0.001", "0.01")) for n in BOTH)])
def test_matches_duckdb(spark, name, sf):
    session.checkpoints(spark)
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    answer = con.sql(catalog.ORACLE_SQL[name])
    at = [answer.columns.index(c) for c in columns]
    assert sorted(answer.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=str)


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
