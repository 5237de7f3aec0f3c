"""Lodestone: a strict SQL dialect on Spark DataFrames, with versioned Parquet tables."""

__version__ = "0.1.0"
