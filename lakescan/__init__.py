"""A Parquet access layer for Spark: footers as DataFrames, typed column reads, row groups, strict and lenient modes."""
