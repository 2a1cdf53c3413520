"""Relational and analytic operators; every one maps DataFrames to DataFrames."""
