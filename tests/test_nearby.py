import math
import random

import numpy as np
import pytest
from pyspark.sql import Row

from landreach.operators import boxes, nearby, triangles

P = "id long, x double, y double"


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def star(r, cx, cy, n, size):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(cx + math.cos(t) * size * r.uniform(0.3, 1), cy + math.sin(t) * size * r.uniform(0.3, 1)) for t in turns]
    return [*pts, pts[0]]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def odd(tiles, x, y):
    """By the parity of triangles, as the plan takes it."""
    n = 0
    for t, _ in tiles:
        for p, q in zip(t, (*t[1:], t[0])):
            p, q = sorted((p, q), key=lambda v: (v[1], v[0]))
            n += p[1] <= y < q[1] and (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) > 0
    return n % 2 == 1


def test_ears_tile_the_ring():
    r = random.Random(5)
    for n in (4, 10, 60, 400):
        turns = [2 * math.pi * (i + r.uniform(0, 0.8)) / n for i in range(n)]
        ring = [(math.cos(t) * d, math.sin(t) * d) for t in turns for d in [r.uniform(0.3, 1)]]
        tiles = triangles.clip_ears([*ring, ring[0]])
        assert len(tiles) == n - 2 and sum(area([*t, t[0]]) for t, _ in tiles) == pytest.approx(area([*ring, ring[0]]))
        assert sum(sum(own) for _, own in tiles) == n  # each side of the ring is one triangle's
    assert triangles.clip_ears([(0, 0), (1, 0), (0, 0)]) == []


TOUCHING = [(0, 0), (10, 0), (10, 10), (4, 10), (6, 12), (6, 9), (0, 10), (0, 0)]


@pytest.mark.parametrize("ring", [
    TOUCHING, [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)],
    [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (8, 0), (8, -4), (0, -4), (0, 0)], [(0, 0), (6, 0), (3, 0), (3, 5), (0, 0)],
    star(random.Random(3), 0, 0, 200, 7),
])
def test_any_ring_keeps_its_parity(ring):
    r, tiles = random.Random(1), triangles.clip_ears(ring)
    for _ in range(2000):
        x, y = r.uniform(-8, 13), r.uniform(-8, 13)
        assert odd(tiles, x, y) == even_odd([ring], x, y)
    for x, y in [(5.0, 5.0), (2.0, 2.0), (4.9, 5.1)]:  # on diagonals of the first ring's fan
        assert ring is not TOUCHING or odd(tiles, x, y)


def test_long_rings_are_cut_fast():
    import time

    n, began = 20_000, time.time()
    wave = lambda i: 1 + sum(math.sin(k * 2 * math.pi * i / n + k * k) / k**1.3 * 0.3 for k in range(2, 60))
    ring = [(wave(i) * math.cos(2 * math.pi * i / n), wave(i) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    began, tiles = time.time(), triangles.clip_ears(ring)
    assert time.time() - began < 5 and len(tiles) == n - 2
    assert sum(area([*t, t[0]]) for t, _ in tiles) == pytest.approx(area([*ring, ring[0]]))


def frame(spark, shapes):
    return spark.createDataFrame([(i, None if s is None else [[Row(x=float(x), y=float(y)) for x, y in ring] for ring in s]) for i, s in shapes], "rid int, rings array<array<struct<x:double,y:double>>>")


def test_regions_match_even_odd(spark):
    r = random.Random(2)
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    bow = [(20.0, 0.0), (30.0, 10.0), (30.0, 0.0), (20.0, 10.0), (20.0, 0.0)]  # crosses itself
    shapes = [(0, [square, hole]), (1, [bow]), (2, [star(r, 5, 5, 30, 6), star(r, 25, 25, 30, 4)]), (3, None), (4, []), (5, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])]
    pts = [(i, r.uniform(-2, 32), r.uniform(-2, 32)) for i in range(3000)]
    want = {(i, k) for i, x, y in pts for k, s in shapes if s and even_odd(s, x, y)}
    dirty = [*pts, pts[0], (None, 5.0, 1.0), (9001, None, 1.0), (9002, math.nan, 1.0)]
    got = nearby.containing_regions(spark.createDataFrame(dirty, P), "id", "x", "y", frame(spark, shapes), "rid", "rings").collect()
    assert len(got) == len(set(got)) and {(g.point_id, g.region_id) for g in got} == want


def test_a_point_on_an_inner_edge_counts_once(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5), (3, 1.5, 0.5)], P)
    got = nearby.containing_regions(pts, "id", "x", "y", frame(spark, [(0, [square])]), "rid", "rings").collect()
    assert sorted(g.point_id for g in got) == [1, 2, 3]


def test_outlines_are_not_within(spark):
    """Of parts, holes and parts that share a border: a point on any outline is outside."""
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    right = [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    fan = [(float(x), float(y)) for x, y in TOUCHING]
    pts = [(0, 0.0, 5.0), (1, 4.0, 5.0), (2, 10.0, 5.0), (3, 5.0, 5.0), (4, 2.0, 2.0), (5, 0.0, 0.0), (6, 6.0, 6.0), (7, 15.0, 5.0), (8, 5.0, 4.0), (9, 8.0, 6.0)]
    got = nearby.containing_regions(spark.createDataFrame(pts, P), "id", "x", "y", frame(spark, [(0, [square, hole]), (1, [square, right]), (2, [fan])]), "rid", "rings").collect()
    want = {(4, 0), (9, 0), *((i, 1) for i in (1, 3, 4, 6, 7, 8, 9)), *((i, 2) for i in (1, 3, 4, 6, 8, 9))}
    assert {(g.point_id, g.region_id) for g in got} == want


def test_pairs_within_a_distance(spark):
    r = random.Random(4)
    a = [(i, r.gauss(0, 50), r.gauss(0, 50)) for i in range(400)] + [(1000, 3.0, 4.0)]
    b = [(i, r.gauss(0, 50), r.gauss(0, 50)) for i in range(150)] + [(500, 0.0, 0.0), (501, 1e9, -1e9)]
    want = {(i, j) for i, x, y in a for j, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= 25}
    assert (1000, 500) in want
    dirty = [*b, b[0], (None, 0.0, 0.0), (7000, None, None)]
    other = spark.createDataFrame(dirty, "oid long, ox double, oy double")
    got = nearby.within_distance(spark.createDataFrame([*a, a[0]], P), "id", "x", "y", other, "oid", "ox", "oy", 5.0).collect()
    assert len(got) == len(want) and {(g.point_id, g.other_id) for g in got} == want


@pytest.mark.parametrize("which", ["points", "others"])
def test_empty_tables(spark, which):
    some, none = spark.createDataFrame([(1, 0.0, 0.0)], P), spark.createDataFrame([], P)
    a, b = (none, some) if which == "points" else (some, none)
    assert nearby.within_distance(a, "id", "x", "y", b, "id", "x", "y", 5.0).count() == 0
    assert nearby.containing_regions(none, "id", "x", "y", frame(spark, [(0, [])]), "rid", "rings").count() == 0


def test_tree_finds_every_box():
    rng = np.random.default_rng(0)
    low = rng.random((37, 2)) * 10
    leaves = np.hstack([low, low + rng.random((37, 2))])
    x, y = rng.random(500) * 11, rng.random(500) * 11
    at, leaf = boxes.Tree.over(leaves).find(x, y)
    want = {(i, k) for i in range(500) for k, b in enumerate(leaves) if b[0] <= x[i] <= b[2] and b[1] <= y[i] <= b[3]}
    assert set(zip(at.tolist(), leaf.tolist())) == want and len(at) == len(want)


def test_extra_columns_are_ignored(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0, 9, "a", 3)], "id long, x double, y double, leaf int, point_id string, other_id int")
    other = spark.createDataFrame([(5, 1.0, 1.0, 9, 0.0)], "oid long, ox double, oy double, leaf int, minx double")
    assert [tuple(r) for r in nearby.within_distance(pts, "id", "x", "y", other, "oid", "ox", "oy", 1.0).collect()] == [(1, 5, 0.0)]
