"""Operators: each takes a DataFrame of order lines (or an earlier result) and returns a DataFrame."""
