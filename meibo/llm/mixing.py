"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, the source's rate.  The expected
copies are summed up along the source (documents by rising size, so a source's tokens come out evenly),
one random offset is added, and a document is emitted once per integer the running sum crosses in it.  So every
document's expected copies are its source's rate; where few long documents hold much of a source, its actual
share misses the target by what one of them weighs.
The running sum is built in two levels: sums per bucket, then inside each bucket, so no source, however
large, is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUB_BUCKETS = 64


def mix_rates(items: DataFrame, targets: DataFrame, size: str = "n_tokens", total: int | None = None) -> DataFrame:
    """Per source of ``targets``: its tokens, and the rate at which its documents are to be used.

    Without ``total`` the mix is the largest in which every source with tokens keeps its share and no
    document is used more than ``max_repeats`` times.  With ``total`` a source that would need more is used
    ``max_repeats`` times and falls short.  A source without tokens can't contribute: its rate is 0.
    """
    have = items.groupBy("source").agg(F.sum(size).alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").fillna({"source_tokens": 0, "source_docs": 0})
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    room = F.when(usable, F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))
    every = Window.partitionBy(F.lit(1))  # one row per source of the target table
    goal = F.lit(float(total)) if total is not None else F.min(room).over(every)
    rate = F.when(usable, F.least(F.col("target_share") * goal / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return t.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def mix(items: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", total: int | None = None, seed: int = 42) -> DataFrame:
    """(key, source, n_tokens, copies): the documents used, with how often each is.

    Documents whose source is null or not in ``targets`` are not used.  No document is used more than its
    source's ``max_repeats``.  Sizes that are null count as 0.  An empty table gives an empty mix.
    """
    items = items.select(F.col(key), "source", F.coalesce(F.col(size), F.lit(0)).alias("n_tokens"))
    rates = mix_rates(items, targets, "n_tokens", total).where(F.col("rate") > 0).select("source", "rate", "max_repeats")
    bucketed = items.join(F.broadcast(rates), "source").withColumns({
        "_band": F.floor(F.log2(F.col("n_tokens") + 1) * 8).cast("int"),
        "_mix": F.xxhash64(F.col(key), F.lit(seed)),
    }).withColumn("_sub", F.pmod(F.col("_mix"), F.lit(SUB_BUCKETS)))
    bucket = ["source", "_band", "_sub"]
    sums = bucketed.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket: at most some 64 sub-buckets of some 200 size bands in a source
    before = Window.partitionBy("source").orderBy("_band", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("n_tokens", "_mix", key)) + F.col("_before")
    walked = bucketed.join(starts, bucket).select(key, "source", "n_tokens", "rate", "max_repeats", rank.alias("_rank"))
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    crossed = F.floor(F.col("_rank") * F.col("rate") + offset) - F.floor((F.col("_rank") - 1) * F.col("rate") + offset)
    out = walked.withColumn("copies", F.least(crossed, F.col("max_repeats")).cast("int"))
    return out.where("copies > 0").select(key, "source", "n_tokens", "copies")


def share_report(mixed: DataFrame, items: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source: target and actual share of the mix's tokens, documents used, highest number of repeats."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"),
    )
    out = mix_rates(items, targets, "n_tokens", total).join(F.broadcast(used), "source", "left").fillna({"mix_tokens": 0, "docs_used": 0, "most_copies": 0})
    every = Window.partitionBy(F.lit(1))
    return out.select(
        "source", "target_share", F.try_divide("mix_tokens", F.sum("mix_tokens").over(every)).alias("actual_share"),
        "source_tokens", "mix_tokens", "source_docs", "docs_used", "most_copies", "max_repeats",
    )
