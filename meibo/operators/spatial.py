"""Points near points, and points in regions.

Regions: every ring is triangulated by ear clipping, the triangles go into a linear bounding-volume
hierarchy (nodes are Morton prefixes of the triangles' centroids, boxes are the aggregate of their
triangles), points descend it level by level as equi-joins on the node with a box test, and the
candidate triangles are tested exactly.  Each edge belongs to one of the triangles at it, so a point on
a diagonal, or on a border of two regions, is counted once; an odd number of rings puts it in the region.

Near points: a grid on the unit sphere scaled to kilometres (no poles, no date line), one side
emitted to every cell its search box meets, the other to its home cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.session import materialize

EARTH_KM = 6371.0088


def has_position(lat: Column, lon: Column) -> Column:
    """False for null or non-finite coordinates, out-of-range ones and (0, 0)."""
    ok = lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _corners(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    return pts


def crosses_itself(pts: list[tuple[float, float]]) -> bool:
    """True if two edges of the closed ring meet elsewhere than at the corner they share, or a corner comes twice."""
    n = len(pts)
    if len(set(pts)) < n:
        return True
    x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    side = lambda ax, ay, bx, by, px, py: np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    for i in range(n - 2):
        k = slice(i + 2, n - (i == 0))
        near = (np.minimum(x[k], x2[k]) <= max(x[i], x2[i])) & (np.maximum(x[k], x2[k]) >= min(x[i], x2[i])) & (np.minimum(y[k], y2[k]) <= max(y[i], y2[i])) & (np.maximum(y[k], y2[k]) >= min(y[i], y2[i]))
        if not near.any():
            continue
        a, b, c, d = (v[k][near] for v in (x, y, x2, y2))
        if ((side(x[i], y[i], x2[i], y2[i], a, b) * side(x[i], y[i], x2[i], y2[i], c, d) <= 0) & (side(a, b, c, d, x[i], y[i]) * side(a, b, c, d, x2[i], y2[i]) <= 0)).any():
            return True
    return False


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles, corners counter-clockwise, that cover a simple ring once.  Repeated end points and straight corners are dropped.

    Fewer than three distinct corners give no triangle.  Only reflex corners can lie in an ear, so only they are
    tested.  A ring that crosses or touches itself has no ear order: ValueError (see ``ring_triangles``).
    """
    pts = _corners(ring)
    n = len(pts)
    if n < 3:
        return []
    if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1])) < 0:
        pts.reverse()
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    bend = lambda i: _cross(pts[before[i]], pts[i], pts[after[i]])
    reflex = {i for i in range(n) if bend(i) < 0}
    out, left, i, stuck = [], n, 0, 0
    while left > 3 and stuck <= left:
        j, k = before[i], after[i]
        a, b, c = pts[j], pts[i], pts[k]
        turn = _cross(a, b, c)
        inside = lambda p: _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0  # noqa: B023, E731
        if turn < 0 or turn > 0 and any(r != j and r != k and inside(pts[r]) for r in reflex):
            i, stuck = k, stuck + 1
            continue
        if turn > 0:
            out.append((a, b, c))
        after[j], before[k] = k, j
        left, stuck, i = left - 1, 0, after[k]
        for r in (j, k):
            (reflex.add if bend(r) < 0 else reflex.discard)(r)
    a, b, c = pts[before[i]], pts[i], pts[after[i]]
    last = _cross(a, b, c)
    if left > 3 or last < 0:
        raise ValueError("the ring crosses itself; it has no ears")
    return out + ([(a, b, c)] if last > 0 else [])


def ring_triangles(ring: list[tuple[float, float]]) -> list[tuple[int, tuple]]:
    """(part, triangle): a point is in the ring, by the even-odd rule, if it is in an odd number of parts.

    A simple ring is one part, its ears.  A ring that crosses or touches itself is fanned out from its first corner,
    each triangle a part of its own: parity over them is the even-odd rule whatever the crossings.
    """
    pts = _corners(ring)
    if len(pts) < 3:
        return []
    if not crosses_itself(pts):
        try:
            return [(0, t) for t in ear_clip(pts)]
        except ValueError:
            pass
    fan = ((pts[0], p, q) for p, q in zip(pts[1:], pts[2:]))
    return [(k, t if _cross(*t) > 0 else (t[0], t[2], t[1])) for k, t in enumerate(fan) if _cross(*t) != 0]


_TRI = "region_id string, ring int, part int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"


def triangulate(regions: DataFrame, region_id: str = "region_id", rings: str = "rings") -> DataFrame:
    """(region_id, ring, part, x1..y3): the triangles of every ring, ring by ring in parallel.

    Null or empty rings, and those with a null or endless coordinate, give no triangle.
    """
    each = regions.select(F.col(region_id).cast("string").alias("region_id"), F.posexplode(rings).alias("ring", "pts")).where(F.size("pts") > 2)
    flat = each.select("region_id", "ring", F.transform("pts", lambda p: p["lon"]).alias("xs"), F.transform("pts", lambda p: p["lat"]).alias("ys"))

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                pts = [(float(x), float(y)) for x, y in zip(r.xs, r.ys) if x is not None and y is not None]
                if len(pts) == len(r.xs) and all(math.isfinite(v) for p in pts for v in p):
                    rows += [(r.region_id, r.ring, part, *a, *b, *c) for part, (a, b, c) in ring_triangles(pts)]
            yield pd.DataFrame(rows, columns=["region_id", "ring", "part", "x1", "y1", "x2", "y2", "x3", "y3"])

    return flat.mapInPandas(clip, _TRI)


def _morton(bits: int) -> Column:
    """Morton prefix of (_cx, _cy), each a cell number below 2**bits."""
    code = F.lit(0).cast("bigint")
    for b in range(bits):
        for axis, shift in (("_cx", 0), ("_cy", 1)):
            bit = F.shiftright(F.col(axis), b).bitwiseAND(F.lit(1)).cast("bigint")
            code = code.bitwiseOR(F.shiftleft(bit, 2 * b + shift))
    return code


def bounding_hierarchy(triangles: DataFrame, per_leaf: int = 8, step: int = 2, max_bits: int = 24) -> tuple[DataFrame, list[DataFrame], int]:
    """Leaves, level tables (parent, child, box) from the root down, and the depth in bits per axis.

    The depth follows the number of triangles (``per_leaf`` in a leaf on average); ``max_bits`` is what a key
    of 64 bits holds.  A level's node is a Morton prefix, its box the union of its triangles' boxes.
    """
    boxed = triangles.select(
        "*",
        F.least("x1", "x2", "x3").alias("bx0"), F.greatest("x1", "x2", "x3").alias("bx1"),
        F.least("y1", "y2", "y3").alias("by0"), F.greatest("y1", "y2", "y3").alias("by1"),
    )
    n, *ext = boxed.agg(F.count(F.lit(1)), F.min("bx0"), F.max("bx1"), F.min("by0"), F.max("by1")).first()
    bits = step
    while bits < max_bits and per_leaf * 4**bits < n:
        bits += step
    # the centroid's cell is taken within the layer's own extent, so that the prefixes separate
    wide = bool(n) and ext[1] > ext[0] and ext[3] > ext[2]
    x0, x1, y0, y1 = (float(v) for v in ext) if wide else (-180.0, 180.0, -90.0, 90.0)
    cell = lambda v, lo, hi: F.floor((v - lo) / (hi - lo) * (2**bits - 1)).cast("bigint")
    leaves = boxed.withColumns({
        "_cx": cell((F.col("x1") + F.col("x2") + F.col("x3")) / 3, x0, x1),
        "_cy": cell((F.col("y1") + F.col("y2") + F.col("y3")) / 3, y0, y1),
    })
    leaves = leaves.withColumn("leaf", _morton(bits)).drop("_cx", "_cy")
    levels = []
    for b in range(step, bits + 1, step):
        node = F.shiftright("leaf", 2 * (bits - b))
        levels.append(
            leaves.groupBy(F.shiftright(node, 2 * step).alias("parent"), node.alias("child"))
            .agg(F.min("bx0").alias("nx0"), F.max("bx1").alias("nx1"), F.min("by0").alias("ny0"), F.max("by1").alias("ny1"))
        )
    return leaves, levels, bits


def _on_left(ax: str, ay: str, bx: str, by: str) -> Column:
    """True where (_x, _y) lies left of the edge a-b, or on it and the edge goes down or, level, to the left.

    The side is computed from the lesser end, so the two triangles at an edge get the same number with opposite
    signs: of all triangles at a border, also of two regions, a point on it is in exactly one.
    """
    a, b, c, d = (F.col(k) for k in (ax, ay, bx, by))
    turned = (a > c) | ((a == c) & (b > d))
    lx, ly, hx, hy = F.when(turned, c).otherwise(a), F.when(turned, d).otherwise(b), F.when(turned, a).otherwise(c), F.when(turned, b).otherwise(d)
    side = ((hx - lx) * (F.col("_y") - ly) - (hy - ly) * (F.col("_x") - lx)) * F.when(turned, -1).otherwise(1)
    return (side > 0) | ((side == 0) & ((d < b) | ((d == b) & (c < a))))


def regions_of_points(points: DataFrame, regions: DataFrame, region_id: str = "region_id", rings: str = "rings") -> DataFrame:
    """(_pid, region_id) of the regions that hold each point of ``points`` (_pid, _x = lon, _y = lat).

    Spark broadcasts a level of the hierarchy while its size is under the session's broadcast limit and
    shuffles it by node otherwise.  Even-odd over rings: a hole or an island
    inside a hole counts by parity.  A point on a border that two regions share is in one of them.
    """
    triangles = materialize(triangulate(regions, region_id, rings), "triangles")
    leaves, levels, bits = bounding_hierarchy(triangles)
    inside = lambda x0, x1, y0, y1: F.col("_x").between(x0, x1) & F.col("_y").between(y0, y1)
    within = lambda b: inside(*(F.col(f"{b}{k}") for k in ("x0", "x1", "y0", "y1")))
    # the first level has sixteen nodes at most: they are tested in place
    roots = [F.when(inside(*(F.lit(r[k]) for k in ("nx0", "nx1", "ny0", "ny1"))), F.lit(r["child"])) for r in levels[0].collect()]
    first = F.array_compact(F.array(*roots)) if roots else F.array().cast("array<bigint>")
    at = points.select("_pid", "_x", "_y", F.explode(first).alias("parent"))
    for level in levels[1:]:
        at = at.join(level, "parent").where(within("n")).select("_pid", "_x", "_y", F.col("child").alias("parent"))
    hit = at.withColumnRenamed("parent", "leaf").join(leaves, "leaf")
    in_tri = _on_left("x1", "y1", "x2", "y2") & _on_left("x2", "y2", "x3", "y3") & _on_left("x3", "y3", "x1", "y1")
    parts = hit.where(within("b") & in_tri).select("_pid", "region_id", "ring", "part").distinct()
    return parts.groupBy("_pid", "region_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 1).select("_pid", "region_id")


CROWD = 2_000


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, km: float = 2.0, cell_km: float | None = None) -> DataFrame:
    """(key_a, key_b): different keys at most ``km`` apart, the smaller key first, each pair once.

    Points are folded to distinct spots first, so copies of a spot are compared once and only
    the stated pairs of keys are expanded from them.  A cell of more than ``CROWD`` spots is dealt over as many
    tasks as it has crowds.  Rows without a position or key are left out.
    """
    cell = cell_km or 2 * km
    rows = points.where(has_position(F.col(lat), F.col(lon)) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    spots = rows.select("lat", "lon").distinct()
    phi, lam = F.radians("lat"), F.radians("lon")
    xyz = {"x": F.cos(phi) * F.cos(lam) * EARTH_KM, "y": F.cos(phi) * F.sin(lam) * EARTH_KM, "z": F.sin(phi) * EARTH_KM}
    spots = spots.withColumns(xyz)
    reach = km * 1.0001
    lo = lambda c: F.floor((F.col(c) - reach) / cell)
    hi = lambda c: F.floor((F.col(c) + reach) / cell)
    sent = spots
    for c in "xyz":
        sent = sent.withColumn("c" + c, F.explode(F.sequence(lo(c), hi(c))))
    home = spots.select(F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), *[F.floor(F.col(c) / cell).alias("c" + c) for c in "xyz"], *[F.col(c).alias(c + "_b") for c in "xyz"])
    cells = ["cx", "cy", "cz"]
    crowds = home.groupBy(cells).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(*cells, F.ceil(F.col("n") / CROWD).cast("int").alias("_parts"))
    home = home.join(crowds, cells, "left").withColumn("_part", F.pmod(F.xxhash64("lat_b", "lon_b"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    sent = sent.join(crowds, cells, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    order = (F.col("lat") < F.col("lat_b")) | ((F.col("lat") == F.col("lat_b")) & (F.col("lon") <= F.col("lon_b")))
    chord = sum((F.col(c) - F.col(c + "_b")) * (F.col(c) - F.col(c + "_b")) for c in "xyz")
    close = (
        sent.join(home, [*cells, "_part"])
        .where(order & (chord <= reach * reach))
        .where(haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= km)
        .select("lat", "lon", "lat_b", "lon_b")
    )
    a = rows.withColumnRenamed("k", "ka")
    b = rows.select(F.col("k").alias("kb"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = close.join(a, ["lat", "lon"]).join(b, ["lat_b", "lon_b"]).where(F.col("ka") != F.col("kb"))
    return pairs.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()

