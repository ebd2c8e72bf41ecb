"""Composed jobs (ingest, reports, forecasting) and the query catalog."""
