"""Scoring text for machine-written style, as Spark jobs."""
