"""Compositions a user calls: ingestion, analysis runs, dashboard queries, table storage."""
