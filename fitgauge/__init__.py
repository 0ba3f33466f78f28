"""Measures, on Spark, which tables and columns are fit for AI work."""

from fitgauge.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
