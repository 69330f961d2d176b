"""Relational and data-quality operators."""
