"""Readers of landed JSON and JSON lines.

A source is a pair: ``read_*`` scans landing files into rows of raw JSON plus their position, and a
normaliser turns such rows into ``RAW_ITEMS``. Normalisers take a DataFrame, so a stream, a table
or a test fixture works as well as a folder.
"""
