import math
import random

import pytest
from pyspark.sql import functions as F

from meibo.operators.spatial import EARTH_KM, bounding_hierarchy, crosses_itself, ear_clip, near_pairs, regions_of_points, triangulate


def hav(a, b):
    (la, lo), (lb, ob) = a, b
    x = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1, x)))


def test_near_pairs_against_brute_force(spark):
    rnd = random.Random(1)
    pts = [(f"L{i}", 35 + rnd.random() * 0.15, 139 + rnd.random() * 0.15) for i in range(150)]
    pts += [("N1", 89.999, 10.0), ("N2", 89.999, -170.0), ("D1", 10.0, 179.999), ("D2", 10.0, -179.999), ("S", 35.1, 139.1), ("T", 35.1, 139.1), ("S", 35.1, 139.1), ("Z", 0.0, 0.0), ("Y", 0.0, 0.0), ("B", 95.0, 10.0), ("C", None, 10.0), (None, 35.1, 139.1)]
    df = spark.createDataFrame([(k, a, b, "x", 1.0) for k, a, b in pts], "k string, la double, lo double, key_a string, cx double")
    got = sorted((r.key_a, r.key_b) for r in near_pairs(df, "k", "la", "lo", 2.0).collect())
    ok = [(k, (a, b)) for k, a, b in pts if k and a is not None and abs(a) <= 90 and not a == b == 0]
    want = sorted({(min(x, y), max(x, y)) for x, p in ok for y, q in ok if x != y and hav(p, q) <= 2.0})
    assert got == want and ("N1", "N2") in got and ("D1", "D2") in got and ("S", "T") in got


def test_ear_clip_covers_concave_rings_once():
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    area = lambda t: abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2
    shoelace = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
    for r in (ring, ring[::-1], ring + ring[:1]):
        assert sum(map(area, ear_clip(r))) == pytest.approx(shoelace)
    assert ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, 0), (1, 1), (2, 2)]) == []


def inside(x, y, rings):
    n = 0
    for ring in rings:
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        n += hit
    return n % 2 == 1


def test_regions_with_holes_and_islands(spark):
    rnd = random.Random(2)
    star = lambda cx, cy, r, n: [(cx + math.cos(2 * math.pi * k / n) * r * (0.6 + 0.4 * rnd.random()), cy + math.sin(2 * math.pi * k / n) * r * (0.6 + 0.4 * rnd.random())) for k in range(n)]
    regions = {"A": [star(130, 35, 3, 40), star(130, 35, 1, 12), star(130, 35, 0.3, 8)], "B": [star(136, 35, 2, 30)], "E": []}
    rdf = spark.createDataFrame([(k, "p", [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in regions.items()], "region_id string, province string, rings array<array<struct<lon double, lat double>>>")
    pts = [(i, 126 + rnd.random() * 13, 31 + rnd.random() * 8) for i in range(400)]
    pdf = spark.createDataFrame(pts, "_pid long, _x double, _y double")
    got = {(r._pid, r.region_id) for r in regions_of_points(pdf, rdf).collect()}
    assert got == {(i, k) for i, x, y in pts for k, rings in regions.items() if inside(x, y, rings)}
    leaves, levels, bits = bounding_hierarchy(triangulate(rdf))
    assert bits >= 2 and levels and leaves.where(F.col("leaf").isNull()).count() == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, la double, lo double")
    assert near_pairs(none, "k", "la", "lo").count() == 0
    rdf = spark.createDataFrame([], "region_id string, rings array<array<struct<lon double, lat double>>>")
    assert regions_of_points(spark.createDataFrame([(1, 1.0, 1.0)], "_pid long, _x double, _y double"), rdf).count() == 0


def test_rings_that_cross_themselves_follow_the_even_odd_rule(spark):
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    rings = {"cross": [(0, 0), (2, 2), (2, 0), (0, 2), (1, 5)], "star": star, "eight": [(0, 0), (2, 2), (2, 0), (0, 2)], "twice": [(0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2)], "none": [(0, 0), (None, 1), (2, 0)]}
    assert all(crosses_itself(r) for k, r in rings.items() if k != "none") and not crosses_itself([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])
    fl = lambda v: None if v is None else float(v)
    rdf = spark.createDataFrame([(k, [[(fl(x), fl(y)) for x, y in r]]) for k, r in rings.items()], "region_id string, rings array<array<struct<lon double, lat double>>>")
    rnd = random.Random(8)
    pts = [(i, rnd.uniform(-1.2, 2.2), rnd.uniform(-1.2, 5.2)) for i in range(600)] + [(600, 1.0, 1.9)]
    got = {(r._pid, r.region_id) for r in regions_of_points(spark.createDataFrame(pts, "_pid long, _x double, _y double"), rdf).collect()}
    assert got == {(i, k) for i, x, y in pts for k, r in rings.items() if k != "none" and inside(x, y, [r])}


def test_a_point_on_a_shared_border_is_in_one_region(spark):
    regions = {"W": [(0, 0), (1.3, 0.1), (1.7, 3.3), (0, 3)], "E": [(1.3, 0.1), (4, 0), (4, 3), (1.7, 3.3)], "N": [(0, 3), (1.7, 3.3), (4, 3), (2, 6)]}
    rdf = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r]]) for k, r in regions.items()], "region_id string, rings array<array<struct<lon double, lat double>>>")
    pts = [(i, 1.3 + 0.4 * i / 64, 0.1 + 3.2 * i / 64) for i in range(1, 64)] + [(100, 1.7, 3.3), (101, 1.5, 1.7)]
    got = [r._pid for r in regions_of_points(spark.createDataFrame(pts, "_pid long, _x double, _y double"), rdf).collect()]
    assert sorted(got) == sorted(p[0] for p in pts)


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    from meibo.operators import spatial

    monkeypatch.setattr(spatial, "CROWD", 5)
    rnd = random.Random(9)
    pts = [(f"L{i}", 35 + rnd.random() * 0.03, 139 + rnd.random() * 0.03) for i in range(60)]
    got = {(r.key_a, r.key_b) for r in near_pairs(spark.createDataFrame(pts, "k string, la double, lo double"), "k", "la", "lo", 2.0).collect()}
    assert got == {(min(x[0], y[0]), max(x[0], y[0])) for x in pts for y in pts if x[0] != y[0] and hav(x[1:], y[1:]) <= 2.0}
