"""Verification of periodic statistical returns against record-level data, as Spark jobs."""

__version__ = "0.1.0"
