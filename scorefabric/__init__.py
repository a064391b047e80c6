"""Spark-first engine for feature derivation, grouped validation and stacking."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
