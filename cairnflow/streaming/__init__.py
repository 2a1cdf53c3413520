"""Repeated ingestion and period counts under Structured Streaming."""
