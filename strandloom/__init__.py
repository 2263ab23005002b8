"""Spark-first analytics over code-structure relations and star-schema tables."""
