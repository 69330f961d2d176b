"""Declared schemas, metrics and their compilation to DataFrames."""
