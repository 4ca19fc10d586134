"""Readers that turn stored bytes into DataFrames."""
