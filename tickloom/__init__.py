"""Tick and candle analytics as ordinary PySpark DataFrame jobs."""
