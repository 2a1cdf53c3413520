"""Operators of a training-data pipeline: scoring, filtering, deduplication and mixing of documents."""
