"""Cyclical demand analytics on Spark: panels, forecasts, back-tests and slot planning."""
