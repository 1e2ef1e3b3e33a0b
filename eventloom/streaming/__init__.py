"""Continuous ingest and live views, on Structured Streaming."""
