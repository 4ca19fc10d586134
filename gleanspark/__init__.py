"""Spark-first engine that turns semi-structured inputs into checked, tidy datasets."""
