"""Trailworks: trajectory analytics and tabular business analytics on Spark."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
