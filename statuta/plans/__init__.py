"""Compositions of operators: asking, harvesting, the catalogue."""
