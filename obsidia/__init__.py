"""Spark operators for grouped sparse measurements."""
