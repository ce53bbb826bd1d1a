"""Descriptive statistics, stratified samples and gold scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.text import fold_col
from meibo.operators.ordered import number_rows


def share_of_total(df: DataFrame, n: str) -> DataFrame:
    """``share``: each row's part of the sum, which is joined as one row."""
    return df.join(F.broadcast(df.agg(F.sum(n).alias("_total")))).withColumn("share", F.try_divide(F.col(n), F.col("_total"))).drop("_total")


def zero_filled(subjects: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Events per subject, 0 for subjects without any."""
    c = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return subjects.select(key).distinct().join(c, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def deciles(df: DataFrame, value: str) -> DataFrame:
    """(decile, value): floor nearest rank, sorted[int(n d / 10) - 1]; a rank below one wraps to the largest value.

    Values fold to counts first, so the running count is over distinct values and no task sorts all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("to", F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    ranked = upto.select("v", "n", (F.col("to") - F.col("c")).alias("from"), "to", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("decile"))
    rank = F.floor(F.col("n") * F.col("decile") / 10)
    at = F.when(rank < 1, F.col("n")).otherwise(rank)
    return ranked.where((at > F.col("from")) & (at <= F.col("to"))).select("decile", F.col("v").alias("value"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n_known, n_rows): non-null counts of the columns in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    return row.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_known")) for c in columns])).alias("x")).select("x.field", "x.n_known", "n_rows")


def by_volume_and_total(df: DataFrame, volumes: str, key: str) -> DataFrame:
    """(volume, key, n): counts per volume and key, per volume, and in all, in one grouping-sets pass."""
    e = df.select(F.explode(volumes).alias("volume"), key)
    return e.groupingSets([["volume", key], ["volume"], []], "volume", key).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def portable_order(key: Column, seed: str) -> Column:
    """A pseudo-random order that any engine repeats: the digest of seed and key."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))


def _first_of(df: DataFrame, by: Sequence[str], key: str, seed: str) -> DataFrame:
    """The first ``_quota`` of ``_size`` rows of each group in a digest order.

    A group of a third of all rows is not sorted in one task: rows above the quota's digest quantile are dropped before the ranking.
    """
    # the digest is uniform: quota / size of the rows lie below that share of its range; eight deviations more never miss
    p = F.col("_quota") / F.col("_size")
    cut = p + 8 * F.sqrt(p / F.col("_size")) + 64 / F.col("_size")
    dealt = df.withColumn("_d", portable_order(F.col(key), seed))
    share = F.conv(F.substring("_d", 1, 8), 16, 10).cast("double") / 4294967296.0
    w = Window.partitionBy(*by).orderBy("_d", key)
    return dealt.where(share <= cut).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_d", "_size", "_quota")


def _with_counts(df: DataFrame, by: Sequence[str], counts: DataFrame) -> DataFrame:
    """``df`` joined to one row per group, a null being a group of its own."""
    same = [F.col("a." + c).eqNullSafe(F.col("b." + c)) for c in by]
    return df.alias("a").join(counts.alias("b"), same).select("a.*", *[F.col("b." + c) for c in counts.columns if c not in by])


def _portion(n: Column, size: Column, whole: Column) -> Column:
    """A stratum's quota: its part of ``n``, at least one, at most its size."""
    return F.least(F.greatest(F.bround(n * size / whole), F.lit(1.0)), size).cast("bigint")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """At most n rows in proportion to the strata, at least one of each before the cut to n; a null stratum is one of its own.

    Each stratum's quota is round(n * share), the rows are the first in a digest order; above n they are drawn from in another one.
    """
    total = float(max(df.count(), 1))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size")).withColumn("_quota", _portion(F.lit(float(n)), F.col("_size"), F.lit(total)))
    taken = _first_of(_with_counts(df, [stratum], sizes), [stratum], key, seed)
    return taken.orderBy(portable_order(F.col(key), seed + "/n"), key).limit(n)


def tertile_sample(df: DataFrame, value: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows, as many from each third of the rows in the order of ``value``; ``tertile`` 0, 1, 2.

    The thirds are cut by position: floor(rows / 3) each, the last with what is left over.  What n leaves over three goes to the first ones.
    """
    known = df.where(F.col(value).isNotNull())
    third = max(known.count() // 3, 1)
    placed = number_rows(known, [value, key], "_at", 0).withColumn("tertile", F.least(F.floor(F.col("_at") / third), F.lit(2)).cast("int")).drop("_at")
    w = Window.partitionBy("tertile").orderBy(portable_order(F.col(key), seed), key)
    quota = F.lit(n // 3) + F.when(F.col("tertile") < n % 3, 1).otherwise(0)
    return placed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota).drop("_rn")


def volume_balanced_sample(df: DataFrame, volume: str, sub: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows split equally over the volumes and, inside a volume, in proportion to the ``sub`` strata.

    What n leaves over goes to the first volumes in order.  What a volume lacks of its quota is topped up from all rows not drawn.
    """
    each = df.groupBy(volume, sub).agg(F.count(F.lit(1)).alias("_size"))
    # one row per volume and stratum
    vols = each.groupBy(volume).agg(F.sum("_size").alias("_rows"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col(volume).cast("string").asc_nulls_last())
    vols = vols.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))), "_k": F.row_number().over(order)})
    share = F.floor(F.lit(n) / F.col("_n")) + F.when(F.col("_k") <= F.pmod(F.lit(n), F.col("_n")), 1).otherwise(0)
    vols = vols.select(volume, "_rows", F.least(share, F.col("_rows")).cast("bigint").alias("_of"))
    quotas = _with_counts(each, [volume], vols).withColumn("_quota", _portion(F.col("_of").cast("double"), F.col("_size"), F.col("_rows"))).where("_of > 0")
    taken = _first_of(_with_counts(df, [volume, sub], quotas), [volume, sub], key, seed)
    w = Window.partitionBy(volume).orderBy(portable_order(F.col(key), seed + "/n"), key)
    sample = taken.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_of")).select(*df.columns)
    lacking = n - sample.count()
    if lacking <= 0:
        return sample
    rest = df.join(sample.select(key), key, "left_anti").select(*df.columns)
    return sample.unionByName(rest.orderBy(portable_order(F.col(key), seed + "/top"), key).limit(lacking))


def balanced_sample(df: DataFrame, cls: str, key: str, per: int, seed: str = "42") -> DataFrame:
    """``per`` rows of each class."""
    w = Window.partitionBy(cls).orderBy(portable_order(F.col(key), seed), key)
    return df.where(F.col(cls).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per).drop("_rn")


def binary_scores(df: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of two Boolean columns."""
    c = df.select(gold.alias("g"), pred.alias("p")).where("g is not null and p is not null").agg(
        F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("not g and p")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"), F.count_if(F.expr("not g and not p")).alias("tn"),
    )
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r}).withColumns({
        "f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
    })


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n) of all pairs of labels met."""
    return df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def cohens_kappa(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(n, observed, expected, kappa): agreement beyond chance."""
    m = confusion(df, gold, pred)
    n = m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)), F.lit(0)).alias("same"))
    g = m.groupBy(F.col("gold").alias("k")).agg(F.sum("n").alias("ng"))
    p = m.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("np"))
    chance = g.join(p, "k").agg(F.coalesce(F.sum(F.col("ng") * F.col("np")), F.lit(0)).alias("chance"))
    o, x = F.try_divide("same", "n"), F.try_divide("chance", F.col("n") * F.col("n"))
    return n.join(F.broadcast(chance)).select("n", o.alias("observed"), x.alias("expected"), F.try_divide(o - x, 1 - x).alias("kappa"))


# Coefficients of the rational approximation of the error function (absolute error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """The complementary error function of a number that is not negative."""
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(only_a, only_b, chi2, p): discordant pairs, the statistic with continuity correction and its p-value."""
    c = df.select(a.alias("a"), b.alias("b")).agg(F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("b and not a")).alias("only_b"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return c.withColumn("chi2", F.try_divide((d * d).cast("double"), F.col("only_a") + F.col("only_b"))).withColumn("p", erfc(F.sqrt(F.col("chi2") / 2)))


def chi2_p(chi2: float) -> float:
    """The p-value of a chi-square of one degree of freedom."""
    return math.erfc(math.sqrt(chi2 / 2))


def list_match(pairs: DataFrame, group: str, pred: str, gold: str, score: str) -> DataFrame:
    """(group, precision, recall, f1): each predicted item's and each gold item's best score, averaged."""
    p = pairs.groupBy(group, pred).agg(F.max(score).alias("s")).groupBy(group).agg(F.avg("s").alias("precision"))
    r = pairs.groupBy(group, gold).agg(F.max(score).alias("s")).groupBy(group).agg(F.avg("s").alias("recall"))
    return p.join(r, group).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion_pivot(df: DataFrame, gold: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """One row per gold label with a count per predicted one, over the union of ``labels`` (zero where none was met)."""
    m = confusion(df, gold, pred)
    spark = df.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], "gold string")
    wide = m.withColumns({"gold": F.col("gold").cast("string"), "pred": F.col("pred").cast("string")}).groupBy("gold").agg(*[F.coalesce(F.sum(F.when(F.col("pred") == x, F.col("n"))), F.lit(0)).alias(f"pred_{x}") for x in labels])
    return every.join(wide, "gold", "left").fillna(0)


def field_scores(pairs: DataFrame, scalars: Sequence[str], partial: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """(field, total, strict, partial, pred_items, gold_items, pred_matched, gold_matched) over rows with columns ``pred_<f>`` and ``gold_<f>``.

    A scalar counts where either side is known; strict is equality after folding, partial also containment for the fields in
    ``partial``.  A list counts where either side has items: strict and partial are equal lengths, and an item is matched
    if it equals, holds or stands in one of the other side.  Items are texts; blank ones are left out of the matching.
    """
    rows = []
    fold = lambda c: fold_col(F.coalesce(c, F.lit("")))
    whole = lambda ok: F.count_if(F.coalesce(ok, F.lit(False)))
    none = F.lit(0).cast("bigint")
    for f in scalars:
        p, g = fold(F.col(f"pred_{f}").cast("string")), fold(F.col(f"gold_{f}").cast("string"))
        known = F.col(f"pred_{f}").isNotNull() | F.col(f"gold_{f}").isNotNull()
        close = (p == g) | ((p != "") & (g != "") & (F.contains(p, g) | F.contains(g, p)) & F.lit(f in partial))
        rows.append(F.struct(F.lit(f).alias("field"), whole(known).alias("total"), whole(known & (p == g)).alias("strict"), whole(known & close).alias("partial"), *[none.alias(k) for k in ("pred_items", "gold_items", "pred_matched", "gold_matched")]))
    for f in lists:
        ps, gs = (F.coalesce(F.col(f"{side}_{f}"), F.array().cast("array<string>")) for side in ("pred", "gold"))
        known = (F.size(ps) > 0) | (F.size(gs) > 0)
        clean = lambda a: F.filter(F.transform(a, fold), lambda x: F.trim(x) != "")
        met = lambda a, b: F.size(F.filter(clean(a), lambda x: F.exists(clean(b), lambda y: F.contains(x, y) | F.contains(y, x)))).cast("bigint")
        same = known & (F.size(ps) == F.size(gs))
        rows.append(F.struct(F.lit(f).alias("field"), whole(known).alias("total"), whole(same).alias("strict"), whole(same).alias("partial"), F.coalesce(F.sum(F.size(clean(ps)).cast("bigint")), none).alias("pred_items"), F.coalesce(F.sum(F.size(clean(gs)).cast("bigint")), none).alias("gold_items"), F.coalesce(F.sum(met(ps, gs)), none).alias("pred_matched"), F.coalesce(F.sum(met(gs, ps)), none).alias("gold_matched")))
    return pairs.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
