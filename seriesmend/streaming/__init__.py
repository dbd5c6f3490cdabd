"""Detectors and corrections on streams of readings."""
