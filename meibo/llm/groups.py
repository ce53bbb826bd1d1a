"""Pairwise matches to groups by low-diameter decomposition.

Each round every vertex draws an exponential head start; clusters grow from the vertices that start
first, hop by hop, and a vertex joins the cluster that reaches it earliest.  Clusters contract to
super-vertices, the edges between clusters are the next round's graph, and the assignments of all
rounds compose to the group.  Growth is cut after ``hops`` hops, which bounds a cluster's diameter and
never joins what is not linked; what it leaves apart the next round joins.  Once two rounds have shrunk the
graph to ``FINISH`` links or fewer, the last recursion takes them in one bounded step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.keys import hot_keys, skew_lookup
from meibo.session import materialize, release

BETA = 0.1
HOPS = 4
MAX_ROUNDS = 64
#: links between clusters that one task may finish, from the third round on
FINISH = 100_000


def head_start(vertex: Column, round_no: int, beta: float = BETA) -> Column:
    """A draw from the exponential distribution of rate ``beta``, fixed by vertex and round."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(round_no)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return -F.log(u) / beta


def _round(edges: DataFrame, round_no: int, hops: int, beta: float) -> tuple[DataFrame, DataFrame]:
    """(clusters, links left) of one round; clusters (v, c): the cluster centre of every vertex of ``edges`` (a, b: each undirected edge once)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    # every vertex is its own neighbour at no distance: a hop reads the labels once, so four hops are four joins
    steps = [edges.select(F.col(x).alias("u"), F.col(y).alias("v"), F.lit(1).alias("step")) for x, y in ("ab", "ba")]
    both = steps[0].unionByName(steps[1]).unionByName(ends.select("u", F.col("u").alias("v"), F.lit(0).alias("step")))
    both = materialize(both.repartition("u"), "edges")
    # either end of a link is a "u": hot ones are told once for growth and contraction
    hot = hot_keys(both, "u")
    label = both.where("step = 0").select("v", (-head_start(F.col("v"), round_no, beta)).alias("at"), F.col("v").alias("c"))
    for _ in range(hops):
        reached = skew_lookup(both, label.withColumnRenamed("v", "u"), "u", "inner", hot=hot)
        best = reached.groupBy("v").agg(F.min(F.struct((F.col("at") + F.col("step")).alias("at"), "c")).alias("m"))
        label = best.select("v", F.col("m.at").alias("at"), F.col("m.c").alias("c"))
    clusters = materialize(label.select("v", "c"), "clusters")
    homes = [clusters.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
    moved = skew_lookup(skew_lookup(edges, homes[0], "a", "inner", hot=hot), homes[1], "b", "inner", hot=hot).where(F.col("ca") != F.col("cb"))
    left = materialize(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    release(both)
    return clusters, left


def _finish(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of at most ``FINISH`` links with the smallest one it is linked to, in one task."""
    kind = edges.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        schema = None

        def root(x: object) -> object:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
        if schema is not None:
            ids = list(above)
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array([root(x) for x in ids], schema.field(0).type)], names=["v", "c"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"v {kind.simpleString()}, c {kind.simpleString()}")


def consolidate(pairs: DataFrame, a: str, b: str, hops: int = HOPS, beta: float = BETA) -> DataFrame:
    """(member, group): every id linked to another one, directly or through others, with one id for its group.

    Null ids and pairs of an id with itself link nothing; repeated and reversed pairs count once; an
    empty table gives no rows.  ``group`` is one of the members, not a particular one.  Round by round
    only counts reach the driver; every round's tables are written to the shared folder.
    """
    edges = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        n = edges.count()
        if not n:
            break
        if k >= 2 and n <= FINISH:
            rounds.append(materialize(_finish(edges), "clusters"))
            break
        clusters, left = _round(edges, k, hops, beta)
        release(edges)
        edges = left
        rounds.append(clusters)
    else:
        raise RuntimeError(f"links are left after {MAX_ROUNDS} rounds")
    if not rounds:
        return edges.select(F.col("a").alias("member"), F.col("b").alias("group"))
    whole = rounds[-1]
    for finer in reversed(rounds[:-1]):
        above = whole.select(F.col("v").alias("c"), F.col("c").alias("g"))
        whole = skew_lookup(finer, above, "c", "left").select("v", F.coalesce("g", "c").alias("c"))
    return whole.select(F.col("v").alias("member"), F.col("c").alias("group"))


def name_groups(members: DataFrame, order: Column) -> DataFrame:
    """(member, group_id): ``group_id`` is the group's smallest member by ``order`` (over column ``member``).

    The smallest member is found by a combined aggregate, then looked up with hot groups spread.
    """
    least = members.groupBy("group").agg(F.min(F.struct(order.alias("o"), F.col("member").alias("m"))).alias("s")).select("group", F.col("s.m").alias("group_id"))
    return skew_lookup(members, least, "group", "left").select("member", "group_id")
