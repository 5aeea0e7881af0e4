"""Spark-first analytics for versioned, multi-source market and fundamentals data."""
