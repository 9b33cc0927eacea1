"""Queries: projections of the driver tables, the operators applied to them, and SQL for each."""
