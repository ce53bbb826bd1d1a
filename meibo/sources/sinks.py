"""Writers: JSON lines, versions of a table, reports, bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.session import materialize, release
from meibo.sources.readers import exists


def write_json_lines(df: DataFrame, path: str) -> None:
    """UTF-8 JSON Lines, replacing what was there."""
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Rows whose keys the Parquet table lacks are appended; returns their number.  A rerun appends nothing twice.

    Only the batch is counted, not the table it is added to.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        done = spark.read.parquet(path).select(*keys).distinct()
        new = new.join(done, keys, "left_anti")
    new = materialize(new, "batch")
    n = new.count()
    if n or not exists(spark, path):
        new.write.mode("append").parquet(path)
    release(new)
    return n


def write_version(df: DataFrame, root: str) -> str:
    """A new version of a table beside the one it may have been read from; returns its folder."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_bundle(frames: dict[str, DataFrame], root: str) -> None:
    """One Parquet folder per frame."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def demoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns as scalars where they hold one value, else as a JSON list: the exchange form of provenance."""
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1)).when(F.size(c) > 1, F.to_json(c))
    return df.withColumns({c: one(c) for c in columns})
