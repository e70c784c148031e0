"""Scorelark: event catalog, result sheets and competitor analytics on Spark."""

__version__ = "0.1.0"
