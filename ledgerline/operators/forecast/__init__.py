"""Forecasters re-aimed as Spark jobs: ridge, boosted trees, ARIMA, trend+seasonality,
sequence windows; metrics, rollout and model comparison."""
