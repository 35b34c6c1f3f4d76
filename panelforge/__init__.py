"""Spark-first analytics for irregular panels: assembly, windows, statistics, spatial estimates."""
