"""Prefix-filtered set-similarity join, plain or weighted by rarity.

Tokens are ordered by global rarity.  Two sets of (weighted) Jaccard similarity t or more share at least
the weight t W of each set of weight W, so the rarest token they share stands where what is left of each
set still weighs t W: only those rare prefixes are joined.  Size and position filters drop most of what is
left, and the similarity is verified exactly where two sets meet; candidates are never written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.operators.ordered import number_rows
from meibo.session import materialize, release

_EPS = 1e-9


def qgrams(text: Column, q: int = 2, mark: Column | None = None) -> Column:
    """The distinct q-grams of a text padded at both ends, each led by ``mark`` so that only equal marks meet."""
    padded = F.concat(F.lit("^" * (q - 1)), text, F.lit("$" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(q)))
    grams = F.array_distinct(grams)
    return F.transform(grams, lambda g: F.concat_ws("|", mark, g)) if mark is not None else grams


def _numbered(ranks: DataFrame, weight: Column) -> DataFrame:
    """(tok, no, w): tokens numbered by rarity, with their weights."""
    return materialize(number_rows(ranks, ["df", "tok"], "no").select("tok", F.col("no").cast("int").alias("no"), weight.alias("w")), "tokens")


def _weighed(sets: DataFrame, numbers: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(id, mark, t, own, total, and what is kept): the tokens of each set with their weights, rarest first, and what they weigh together."""
    each = sets.select("id", F.explode("tokens").alias("tok")).join(numbers.hint("merge"), "tok").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "w"))).alias("own"))
    total = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["w"])
    return each.withColumn("total", total).join(sets.select("id", "mark", "t", *keep).hint("merge"), "id")


def _prefix(weighed: DataFrame) -> DataFrame:
    """A row for each token from which on a set still weighs what a partner must share: ``rest``."""
    steps = F.aggregate(
        "own", F.struct(F.col("total").alias("rest"), F.array().cast("array<struct<no: int, rest: double>>").alias("out")),
        lambda s, x: F.struct((s["rest"] - x["w"]).alias("rest"), F.concat(s["out"], F.array(F.struct(x["no"].alias("no"), s["rest"].alias("rest")))).alias("out")),
    )["out"]
    at = F.filter(steps, lambda x: x["rest"] >= F.col("t") * F.col("total") - _EPS)
    return weighed.withColumn("_at", F.explode(at)).withColumns({"no": F.col("_at.no"), "rest": F.col("_at.rest")}).drop("_at")


def similar_sets(left: DataFrame, right: DataFrame | None, t: float | str, key: str = "id", tokens: str = "tokens", mark: str | None = None, weighted: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(id_l, id_r, jaccard) of all pairs of sets with Jaccard similarity of at least ``t``, and each column of ``keep`` from either side (_l, _r).

    With ``right`` None, the pairs within ``left``, each once with id_l < id_r.  Empty and null sets pair with
    nothing.  Keys must be unique on each side.  No cap on partners or candidates.  ``mark`` names a column of
    which only equal values meet (null is a value); rarity is counted over all of them.  ``t`` may name a column that is one
    for each mark.  ``weighted``: a token weighs log(1 + sets / sets that hold it), so rare ones count more.

    A set goes with each token of its prefix, so that a pair is verified where it meets, at the rarest token it shares:
    what is shuffled grows with the sets, however many candidates there are.
    """
    one = lambda df: df.select(
        F.col(key).alias("id"), F.coalesce(F.col(mark).cast("string"), F.lit("")).alias("mark") if mark else F.lit("").alias("mark"),
        (F.col(t) if isinstance(t, str) else F.lit(float(t))).alias("t"), F.array_distinct(tokens).alias("tokens"), *keep,
    ).where(F.size("tokens") > 0)
    sets = one(left)
    other = None if right is None else one(right)
    both = sets.select("tokens") if other is None else sets.select("tokens").unionByName(other.select("tokens"))
    ranks = both.select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    numbers = _numbered(ranks, F.log(F.lit(1.0) + F.lit(float(both.count())) / F.col("df")) if weighted else F.lit(1.0))
    # read for both sides: written once instead of planned and computed twice.  The sets are
    # far larger in memory than in their files, so no side is left to be broadcast by its file size
    a = materialize(_weighed(sets, numbers, keep), "weighed-sets")
    b = a if other is None else materialize(_weighed(other, numbers, keep), "weighed-sets")
    release(numbers)
    side = lambda df, s, has: _prefix(df).select("mark", "no", *has, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "total", "rest", *keep)])
    l = side(a, "l", [F.col("t"), F.col("own").alias("own_l")])  # noqa: E741
    r = side(b, "r", [F.col("own.no").alias("own_r")])
    # what two sets must share
    total = F.col("total_l") + F.col("total_r")
    least = total * (F.col("t") - _EPS) / (1 + F.col("t") - _EPS)
    # negative if the token they meet at is not the first one they share
    shared = F.aggregate("own_l", F.lit(0.0), lambda s, x: F.when(F.array_contains("own_r", x["no"]), F.when((s != 0) | (x["no"] == F.col("no")), s + x["w"]).otherwise(F.lit(-1e300))).otherwise(s))
    sized = (F.col("total_r") >= F.col("total_l") * F.col("t") - _EPS) & (F.col("total_l") >= F.col("total_r") * F.col("t") - _EPS)
    # from the first token two sets share, the lighter rest bounds what they share
    met = sized & (F.least("rest_l", "rest_r") >= least - _EPS)
    if other is None:
        met = (F.col("id_l") < F.col("id_r")) & met
    pairs = l.join(r.hint("merge"), ["mark", "no"]).where(met & (shared >= least))
    return pairs.select("id_l", "id_r", (shared / (total - shared)).alias("jaccard"), *[f"{c}_{s}" for c in keep for s in "lr"])
