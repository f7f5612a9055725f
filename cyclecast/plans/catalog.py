"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from cyclecast.plans import backtests, checks, choices, curves, daily, levels, nodefolds, panels, planning, pooled, scenarios, shapes, smoothing

FLAGSHIP = "item_panel"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (panels, backtests, shapes, planning, levels, scenarios, checks, daily, curves, nodefolds, smoothing, choices, pooled):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
