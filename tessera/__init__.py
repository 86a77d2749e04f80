"""Spark-first engine for reconciling, scoring and curating extracted data."""
