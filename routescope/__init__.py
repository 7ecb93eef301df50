"""Spark-first analytics over captured language-model signals."""
