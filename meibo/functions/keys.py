"""Identifier keys and skew-proof lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width forms of the printable ASCII characters.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_EDGE = r"[\s\p{Z}\p{Cc}​﻿]+"


def id_key(col: Column | str) -> Column:
    """One spelling of an identifier: width, case, outer white space and leading zeros are ignored.

    Null, empty, blank and the word NULL (in any case) give null.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.upper(F.translate(c, _WIDE, _NARROW))
    c = F.regexp_replace(c, f"^{_EDGE}|{_EDGE}$", "")
    c = F.regexp_replace(c, r"^(\D*)0+(?=\d)", "$1")
    return F.when((c == "") | (c == "NULL"), F.lit(None).cast("string")).otherwise(c)


HOT_SHARE = 512
HOT_ROWS = 200_000


def hot_keys(big: DataFrame, key: str, share: int = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """Keys that hold more than 1/share of all rows (and at least ``least`` rows).

    There are fewer than ``share`` such keys whatever the table's size, so the list is safe
    on the driver.  The counts are combined before the shuffle.
    """
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.col("n").desc()).limit(share).collect()
    if not top:
        return []
    total = big.count()
    return [r[key] for r in top if r["n"] * share > total]


def skew_lookup(
    big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 64, hot: list | None = None, least: int = HOT_ROWS
) -> DataFrame:
    """``big`` joined to ``small`` (unique on ``key``) where a few keys may hold a third of ``big``.

    Rows of hot keys are spread over ``salts`` groups by a digest of the row, the same when a task is run again, and only the hot rows of ``small`` are repeated.
    Both sides are hash-partitioned, sorted and merged; no side is broadcast by force.
    """
    hot = hot_keys(big, key, least=least) if hot is None else hot
    if not hot:
        return big.join(small.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
