"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree of free room.

The documents are dealt at random (by a hash of their id) into groups of bounded size, and each group
is packed on its own.  A group's loss is at most its last, part-filled containers, so groups of tens of
thousands of items leave as little room as one global packing would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 20_000
MAX_KINDS = 1000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; items are taken by falling size, ties in the order given.

    The tree's leaves are containers, an inner node holds the largest free room below it, so the first
    container with enough room is found going down once.  Sizes above the capacity are refused.
    """
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    if n == 0:
        return out
    if int(sizes.max()) > capacity:
        raise ValueError("an item exceeds the capacity; it has to be cut first")
    width = 1
    while width < n:
        width *= 2
    room = [capacity] * (2 * width)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need, node = int(sizes[i]), 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        out[i] = node - width
        room[node] -= need
        node //= 2
        while node:
            a, b = room[2 * node], room[2 * node + 1]
            best = a if a > b else b
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def cut_oversize(items: DataFrame, size: str, capacity: str = "capacity_tokens") -> DataFrame:
    """Items as pieces (``piece``, ``first_token``, ``piece_tokens``): one, or full containers and a rest where an item exceeds the capacity."""
    n = F.greatest(F.ceil(F.col(size) / F.col(capacity)).cast("int"), F.lit(1))
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    first = F.col("piece").cast("bigint") * F.col(capacity)
    return cut.withColumn("first_token", first).withColumn("piece_tokens", F.least(F.col(size) - first, F.col(capacity).cast("bigint")))


def pack(items: DataFrame, settings: DataFrame, key: str = "doc_id", size: str = "n_tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every item in a container of every kind of ``settings`` (container_kind, capacity_tokens).

    Gives (container_kind, container_id, key, piece, first_token, piece_tokens).  An item is cut only if it
    alone exceeds the capacity: into full containers and a rest.  Items of size 0 or null take no room but
    are assigned.  Settings without a positive capacity are left out.  No items, no rows.  Every task
    packs one group of about ``group_items`` pieces, however many items share a size or a source.
    """
    kinds = settings.where(F.col("capacity_tokens") > 0).select("container_kind", "capacity_tokens").distinct().limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    # the kinds are a setting of a few rows: each item is repeated once per kind, without a join
    each = F.array(*[F.struct(F.lit(k[0]).cast("string").alias("container_kind"), F.lit(int(k[1])).alias("capacity_tokens")) for k in kinds])
    each = each if kinds else F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
    whole = items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size"), F.inline(each))
    pieces = cut_oversize(whole, "_size")
    full = pieces.where(F.col("piece_tokens") == F.col("capacity_tokens"))
    rest = pieces.where(F.col("piece_tokens") < F.col("capacity_tokens"))
    groups = rest.groupBy("container_kind").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(group_items)), F.lit(1)).alias("_groups"))
    dealt = rest.join(F.broadcast(groups), "container_kind").withColumn("_group", F.pmod(F.xxhash64(key, "piece", "container_kind"), F.col("_groups")))
    kind = items.schema[key].dataType.simpleString()
    schema = f"container_kind string, container_id string, {key} {kind}, piece int, first_token bigint, piece_tokens bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_tokens", key, "piece"], ascending=[False, True, True], ignore_index=True)
        at = first_fit_decreasing(pdf["piece_tokens"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        pdf["container_id"] = [f"{g}-{n}" for g, n in zip(pdf["_group"], at)]
        return pdf[["container_kind", "container_id", key, "piece", "first_token", "piece_tokens"]]

    packed = dealt.groupBy("container_kind", "_group").applyInPandas(run, schema)
    alone = full.select("container_kind", F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("piece").cast("string")).alias("container_id"), key, "piece", "first_token", "piece_tokens")
    return packed.unionByName(alone)


def fill_report(packed: DataFrame, settings: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens held, and the share of room left."""
    per = packed.groupBy("container_kind").agg(F.sum("piece_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.count_distinct("container_id").alias("n_containers"))
    joined = per.join(F.broadcast(settings.select("container_kind", "capacity_tokens").distinct()), "container_kind")
    room = F.col("n_containers") * F.col("capacity_tokens")
    return joined.select("container_kind", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", (1 - F.col("n_tokens") / room).alias("unused_share"))

