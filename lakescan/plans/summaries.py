"""Whole-table summaries: totals of columns, first values, and counts that footers answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.session import DEFAULTS


def column_totals(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """n_rows, and sum_<column> of each, nulls skipped, rounded (sums of floats depend on their order)."""
    return df.agg(F.count("*").alias("n_rows"), *(F.round(F.sum(c), digits).alias(f"sum_{c}") for c in columns))


def first_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns' values in the first row of the file (min_by of the row's place: no sort, no ordered shuffle)."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    return df.select(*columns, at.alias("_at")).agg(*(F.min_by(F.struct(c), "_at").getField(c).alias(c) for c in columns))


def total_bytes(groups: DataFrame) -> DataFrame:
    """Of row_groups()."""
    return groups.groupBy("path").agg(F.sum("total_byte_size").alias("total_byte_size"), F.sum("num_rows").alias("num_rows"))


def footer_summary(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """n_rows, and the least and largest of a column, answered by footers: no page is read (PushedAggregation)."""
    other = spark.newSession()
    for key, value in (DEFAULTS | {"spark.sql.sources.useV1SourceList": ""}).items():
        other.conf.set(key, value)
    df = other.read.parquet(path)
    extra = [F.min(column).alias("least"), F.max(column).alias("largest")] if column else []
    return df.agg(F.count("*").alias("n_rows"), *extra)


def full_scan(df: DataFrame) -> DataFrame:
    """Decode every value: the number of rows and of values that are there, by column."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in df.columns))


def preview(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first n values in the file's order, and how many more there are."""
    place = F.col("_metadata.row_index")
    rows = df.select(place.alias("row_index"), column).where(F.col("row_index") < n)
    more = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return rows.crossJoin(F.broadcast(more))  # one row
