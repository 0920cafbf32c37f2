"""Spark jobs over one flat table of order lines: clean, profile, aggregate, segment, forecast, report."""
