"""Audit and repair of timestamped measurement tables on Spark."""

from seriesmend.model import SeriesSpec

__all__ = ["SeriesSpec"]
