"""Demand planning on Spark: panels, features, forecasts, reconciliation, intervals, stock, allocation and simulation."""
