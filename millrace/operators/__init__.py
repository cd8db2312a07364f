"""Batch operators: joins, aggregates, windows, ranking and set operations."""
