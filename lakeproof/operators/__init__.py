"""Joins, aggregations, windows, graph and decision operators."""
