"""Operators over training text; nothing outside this folder imports it."""
