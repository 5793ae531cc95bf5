"""Spark-first analytics over measurement records reported by many sources."""
