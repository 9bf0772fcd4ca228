"""Composed plans: the standard workload over a table directory, the staged pipeline, oracle SQL."""
