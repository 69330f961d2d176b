"""Spark-first analytics engine for governed, multi-tenant data."""
