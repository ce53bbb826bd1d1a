"""Columnar tables of a data set: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``directory``; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
