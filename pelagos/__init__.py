"""Pelagos: a Spark-first analytics engine for maritime observation data."""
