"""Networks of persons and organisations: edges, degrees, components, centralities."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.functions.keys import hot_keys, skew_lookup
from meibo.session import materialize, release

MAX_PERSONS, MAX_NODES = 2000, 4000


def bipartite_edges(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst, weight): distinct links with the number of rows behind each."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected graph."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, by min-label propagation with pointer jumping.

    Labels meet edges on the node, those of hot nodes spread; the minimum is combined before the shuffle.  Only a
    Boolean and the hot nodes reach the driver.  Labels that still move after ``most`` rounds are an error.
    """
    both = materialize(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u <> v").distinct(), "edges")
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("c")), "labels")
    hot = hot_keys(both, "u")
    for _ in range(most):
        heard = skew_lookup(both, label.select(F.col("node").alias("u"), "c"), "u", "inner", hot=hot).select(F.col("v").alias("node"), "c")
        low = label.select("node", "c").unionByName(heard).groupBy("node").agg(F.min("c").alias("c"))
        jump = low.join(low.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("c"))
        nxt = materialize(jump.join(label.select("node", F.col("c").alias("was")), "node").withColumn("moved", F.col("c") < F.col("was")).drop("was"), "labels")
        moved = nxt.where("moved").limit(1).count()
        release(label)
        label = nxt.drop("moved")
        if not moved:
            return label.select("node", F.col("c").alias("component"))
    raise RuntimeError(f"labels still move after {most} rounds")


def large_components(parts: DataFrame, share: float = 0.05) -> DataFrame:
    """(component, size): components of at least ``share`` of the largest."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.agg(F.max("size")).first()[0] or 0
    return sizes.where(F.col("size") >= top * share)


def centralities(edges: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """(node, degree, closeness, betweenness, eigenvector) of one bounded graph, in one task.

    Shortest paths need the whole graph; it is refused above ``most`` nodes, as a picture of more is unreadable.
    """
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).distinct().limit(most + 1).count()
    if nodes > most:
        raise ValueError(f"more than {most} nodes; filter the graph first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for s, d in sorted(set(zip(pdf["src"], pdf["dst"]))):
            if s != d:
                near.setdefault(s, []).append(d)
                near.setdefault(d, []).append(s)
        near = {k: sorted(set(v)) for k, v in near.items()}
        between, close = dict.fromkeys(near, 0.0), {}
        for s in near:
            order, ahead, paths, dist = [], {k: [] for k in near}, dict.fromkeys(near, 0), {s: 0}
            paths[s] = 1
            queue = deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for w in near[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        ahead[w].append(v)
            total = sum(dist.values())
            close[s] = (len(dist) - 1) / total if total else 0.0
            credit = dict.fromkeys(near, 0.0)
            for w in reversed(order):
                for v in ahead[w]:
                    credit[v] += paths[v] / paths[w] * (1 + credit[w])
                if w != s:
                    between[w] += credit[w] / 2
        vec = dict.fromkeys(near, 1.0)
        for _ in range(200):
            new = {k: vec[k] + sum(vec[w] for w in near[k]) for k in near}
            top = max(new.values(), default=1.0) or 1.0
            vec = {k: x / top for k, x in new.items()}
        rows = [(k, len(near[k]), close[k], between[k], vec[k]) for k in sorted(near)]
        return pd.DataFrame(rows, columns=["node", "degree", "closeness", "betweenness", "eigenvector"])

    return edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(1).alias("_g")).groupBy("_g").applyInPandas(lambda p: run(p), "node string, degree bigint, closeness double, betweenness double, eigenvector double")


def within_guard(n_persons: int, n_nodes: int) -> bool:
    """True if a network is small enough to be drawn."""
    return n_persons <= MAX_PERSONS and n_nodes <= MAX_NODES


def neighbours(edges: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """Edges that touch one of the given nodes."""
    return edges.where(F.col("src").isin(*nodes) | F.col("dst").isin(*nodes))
