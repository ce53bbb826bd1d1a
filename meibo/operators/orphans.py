"""References to records that do not exist.

References and parent validity are co-partitioned on the normalised key, sorted and merged
(Spark's sort-merge join); a parent key arrives as one row with all its validity intervals, so
the merge meets each reference once and tells missing, late and deleted parents apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.keys import id_key, skew_lookup

STATUS_MISSING, STATUS_LATE, STATUS_DELETED = "missing", "late", "deleted"


def parent_intervals(parents: DataFrame, key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """One row per key: ``_key`` and ``_spans``, its distinct [loaded, deleted) intervals in time order.

    Rows without a key or without a load time give no interval.  Copies of a row fold into one span.
    """
    gone = F.col(deleted) if deleted in parents.columns else F.lit(None).cast("timestamp")
    return (
        parents.select(id_key(key).alias("_key"), F.col(loaded).alias("since"), gone.alias("until"))
        .where(F.col("_key").isNotNull() & F.col("since").isNotNull())
        .groupBy("_key")
        .agg(F.sort_array(F.collect_set(F.struct("since", "until"))).alias("_spans"))
    )


def references(rows: DataFrame, table_name: str, row_key: str, field: str, loaded: str = "loaded_at", period: Column | None = None) -> DataFrame:
    """The non-null references of one field, as (table_name, row_id, ref_field, _key, _at, period)."""
    return rows.select(
        F.lit(table_name).alias("table_name"),
        F.col(row_key).cast("bigint").alias("row_id"),
        F.lit(field).alias("ref_field"),
        id_key(field).alias("_key"),
        F.col(loaded).alias("_at"),
        (period if period is not None else F.lit(None).cast("string")).alias("period"),
    ).where(F.col("_key").isNotNull())


def _valid(span: Column) -> Column:
    return (span["since"] <= F.col("_at")) & (span["until"].isNull() | (span["until"] > F.col("_at")))


def orphan_references(refs: DataFrame, parents: DataFrame, hot_least: int = 200_000) -> DataFrame:
    """References without a parent valid when the referring row was loaded, plus ``status``.

    ``refs`` as from ``references``, ``parents`` as from ``parent_intervals``.
    status: ``missing`` (no such key ever), ``late`` (every interval begins after the reference),
    ``deleted`` (an interval began in time, none was open).  A reference without load time can
    match no interval and counts as ``missing`` or, if the key exists, ``late``.
    Every referring row is a case of its own, repeated rows included; empty tables give no rows.
    """
    joined = skew_lookup(refs, parents, "_key", "left", least=hot_least)
    began = F.exists("_spans", lambda s: s["since"] <= F.col("_at"))
    status = (
        F.when(F.col("_spans").isNull(), STATUS_MISSING)
        .when(F.exists("_spans", _valid), F.lit(None).cast("string"))
        .when(began, STATUS_DELETED)
        .otherwise(STATUS_LATE)
    )
    return joined.withColumn("status", status).where(F.col("status").isNotNull()).drop("_spans")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, period and status; the counts are combined before the shuffle."""
    return orphans.groupBy("table_name", "ref_field", "period", "status").agg(F.count(F.lit(1)).alias("n_orphans"))
