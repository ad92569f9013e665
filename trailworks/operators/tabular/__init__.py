"""Tabular business operators."""
