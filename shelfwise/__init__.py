"""Retail price catalogue on Spark: feeds, catalogue merges, product search and basket comparison."""

__version__ = "0.1.0"
