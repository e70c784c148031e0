"""Incremental ingest and event-time aggregation."""
