"""Order-sensitive operators: every one names the order it needs, none relies on physical row order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.era import SAME, era_base, era_name, era_number
from meibo.functions.similarity import ratio
from meibo.session import materialize

NEAR_DUPLICATE = 0.85


def path_numbers(path: Column) -> Column:
    """The integers of a path in order: the sort key of scanned files."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def enumerate_rows(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), name: str = "index", start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in the given order within the given groups, or over the whole table by ranges."""
    if not within:
        return number_rows(df, list(order), name, start)
    w = Window.partitionBy(*within)
    return df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1 + start).cast("bigint"))


def _ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` cut into sorted ranges, with the range's number as ``_part``; written, so that no retry cuts otherwise."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_count(df: DataFrame, within: str, order: str, counted: Column, name: str) -> DataFrame:
    """How often ``counted`` held up to each row of its group, by ranges: no group, however large, is sorted in one task.

    Rows with a null group form one of their own.
    """
    ranged = _ranges(df, [within, order])
    local = ranged.withColumn("_local", F.count_if(counted).over(Window.partitionBy("_part", within).orderBy(order)))
    # one row for each range and group in it
    sums = ranged.groupBy("_part", within).agg(F.count_if(counted).alias("_n"))
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").withColumnRenamed(within, "_within")
    joined = local.join(starts.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & F.col(within).eqNullSafe(F.col("_within")))
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_of", "_within", "_local", "_before")


def stitch(segments: DataFrame, within: str, order: str, kind: str = "segment_type", body: str = "body_text") -> DataFrame:
    """Entries with their continuations: a standard segment opens an entry, orphans after it are appended.

    Orphans before the first entry and full-row segments are left out.  Null bodies count as empty.  Entries are
    numbered by ranges, so a volume of any size is spread.
    """
    numbered = running_count(segments.where(F.col(kind).isin("standard", "orphan")), within, order, F.col(kind) == "standard", "entry")
    parts = numbered.where("entry > 0").groupBy(within, "entry").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n_segments"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(body, F.lit("")).alias("b")))), lambda s: s["b"]), " ").alias("text"),
    )
    return parts


def stitch_dropping_duplicates(segments: DataFrame, within: str, order: str, threshold: float = NEAR_DUPLICATE, kind: str = "segment_type", body: str = "body_text") -> DataFrame:
    """As ``stitch``, but a standard segment whose text nearly equals the open entry's is dropped.

    The open entry stays open then, so later orphans go on it; the comparison sees the orphans already
    appended.  That feedback makes it a fold: each group (a volume's page run) is read once in order, with
    only the open entry in memory.
    """
    schema = f"{within} string, first bigint, n_segments bigint, text string"

    # rows of a group arrive sorted and in batches, so a volume of any length is never in memory at once
    src = segments.select(within, order, kind, body).withColumn(within, F.col(within).cast("string")).where(F.col(within).isNotNull())
    parts = src.repartition(within).sortWithinPartitions(within, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            for key, group in pdf.groupby(within, sort=False):
                if state and state["key"] != key:
                    yield pd.DataFrame(state["out"] + [(state["key"], state["first"], state["n"], state["text"])] * (state["first"] is not None), columns=[within, "first", "n_segments", "text"])
                    state = {}
                if not state:
                    state = {"key": key, "first": None, "n": 0, "text": "", "out": []}
                _step(state, group, order, kind, body, threshold)
            if state and state["out"]:
                yield pd.DataFrame(state["out"], columns=[within, "first", "n_segments", "text"])
                state["out"] = []
        if state and state["first"] is not None:
            yield pd.DataFrame([(state["key"], state["first"], state["n"], state["text"])], columns=[within, "first", "n_segments", "text"])

    return parts.mapInPandas(run, schema)


def _step(state: dict, rows: pd.DataFrame, order: str, kind: str, body: str, threshold: float) -> None:
    for o, k, b in zip(rows[order], rows[kind], rows[body]):
        b = b if isinstance(b, str) else ""
        if k == "orphan" and state["first"] is not None:
            state["text"] += " " + b
            state["n"] += 1
        elif k == "standard":
            if state["first"] is not None:
                old, new = state["text"].strip(), b.strip()
                if old and new and ratio(old, new) >= threshold:
                    continue
                state["out"].append((state["key"], state["first"], state["n"], state["text"]))
            state.update(first=o, n=1, text=b)


def carry_era(dates: DataFrame, within: Sequence[str], order: Sequence[str], raw: str) -> DataFrame:
    """``western``: the year of each raw date in document order, "the same era" taking the last one named before."""
    era, number = era_name(F.col(raw)), era_number(F.col(raw))
    own = F.when((era != SAME) & number.isNotNull(), era)
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    named = dates.withColumn("_named", F.last(own, ignorenulls=True).over(w))
    used = F.when(era == SAME, F.col("_named")).otherwise(era)
    return named.withColumn("western", (era_base(used) + number).cast("int")).drop("_named")


def latest(df: DataFrame, within: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_job_order(year: str, current: str, *ties: str) -> list[Column]:
    """Dated jobs first, later before earlier, current before former, then the given ties."""
    return [F.col(year).isNull().asc(), F.col(year).desc_nulls_last(), F.coalesce(F.col(current), F.lit(False)).desc(), *[F.col(t).asc_nulls_last() for t in ties]]


def ordinal_order_conflicts(df: DataFrame, within: Sequence[str], rank: str, year: str, ties: Sequence[str]) -> DataFrame:
    """``conflict``: True for all rows of a group in which a later ordinal was born before an earlier one."""
    known = F.col(year).isNotNull() & F.col(rank).isNotNull()
    w = Window.partitionBy(*within, known).orderBy(rank, *ties)
    fell = df.withColumn("_before", F.lag(F.when(known, F.col(year))).over(w)).withColumn("_fell", known & (F.col(year) < F.col("_before")))
    return fell.withColumn("conflict", F.coalesce(F.max("_fell").over(Window.partitionBy(*within)), F.lit(False))).drop("_before", "_fell")


def unique_role_conflicts(df: DataFrame, within: Sequence[str], role: str, roles: Sequence[str]) -> DataFrame:
    """``conflict``: True where a role that can be held once is held by several rows of a group."""
    w = Window.partitionBy(*within, role)
    return df.withColumn("conflict", F.col(role).isin(*roles) & (F.count(F.lit(1)).over(w) > 1))


def exclusive_pair_conflicts(df: DataFrame, within: Sequence[str], role: str, first: str, second: str) -> DataFrame:
    """``conflict``: True for rows of either role in a group that has both."""
    w = Window.partitionBy(*within)
    both = F.max((F.col(role) == first).cast("int")).over(w) + F.max((F.col(role) == second).cast("int")).over(w) == 2
    return df.withColumn("conflict", F.coalesce(both & F.col(role).isin(first, second), F.lit(False)))


def fill_years(df: DataFrame, within: Sequence[str], order: Sequence[str], year: str, name: str = "filled") -> DataFrame:
    """Missing years from the neighbours in order: between two the average, after one +0.5, before one -0.5."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = F.last(year, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(year, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    guess = F.when(before.isNotNull() & after.isNotNull(), (before + after) / 2.0).when(before.isNotNull(), before + 0.5).when(after.isNotNull(), after - 0.5)
    return df.withColumn(name, F.coalesce(F.col(year).cast("double"), guess))


def next_value(df: DataFrame, within: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The value of the next row in order."""
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*within).orderBy(*order)))


def first_seen_ids(df: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    """(key, id): ids in the order in which keys first appear.

    Keys are first reduced to one row each; positions then come from sorted ranges of keys whose counts are
    added up, so no single task numbers all keys.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return number_rows(firsts, ["_first", key], "_n").select(key, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("id"))


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Rows numbered in a global order without one task that holds them all: ranges are sorted, counted and offset."""
    ranged = _ranges(df, order)
    w = Window.partitionBy("_part").orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(w))
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local") - 1 + start).drop("_part", "_local", "_before")

