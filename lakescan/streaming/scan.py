"""A folder of Parquet files as a stream, with the schema resolved from the files that are there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakescan.sources import footer as FT
from lakescan.sources import resolver as R


def read_stream(spark: SparkSession, folder: str, like: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files become rows as they arrive; like: the file whose footer gives the schema (or all that the folder has)."""
    footers = [FT.read_footer(spark, like)] if like else FT.kinds_of(spark, folder)
    reader = spark.readStream.schema(R.merged([R.read_schema(f) for f in footers]))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
