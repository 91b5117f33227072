"""Reading the tables of a data folder, with only the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    """One parquet table (a file or a folder of files); ``cols`` prunes at the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*cols) if cols else df
