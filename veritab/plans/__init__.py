"""Compositions of operators: gates, reports, the query catalogue."""
