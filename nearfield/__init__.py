"""Neighbourhood robustness analytics on Spark."""
