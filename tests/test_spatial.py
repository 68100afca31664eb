"""Ear clipping, the hierarchy, points in regions and near pairs against naive Python."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import spatial
from tessera.session import materialize


def star(draw, lat, lon, corners, reach):
    """A simple polygon that need not be convex, around a place."""
    turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    while max((b - a) % (2 * math.pi) for a, b in zip(turns, turns[1:] + turns[:1], strict=True)) > 2.5:
        turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    centre = spatial.unit_vectors(np.array([lat]), np.array([lon]))
    east, north = spatial._tangents(centre)
    ring = []
    for t in turns:
        r = reach * draw.uniform(0.2, 1)
        p = centre[0] + r * (math.cos(t) * east[0] + math.sin(t) * north[0])
        p /= np.linalg.norm(p)
        ring.append((math.degrees(math.asin(p[2])), math.degrees(math.atan2(p[1], p[0]))))
    return ring


def inside(ring, lat, lon):
    """Even-odd rule in the plane that touches the sphere at the ring's middle."""
    corners = spatial.unit_vectors(*np.array(ring).T)
    middle = corners.mean(axis=0)
    middle /= np.linalg.norm(middle)
    p = spatial.unit_vectors(np.array([lat]), np.array([lon]))[0]
    if p @ middle <= 0:
        return False
    east, north = spatial._tangents(middle[None])
    flat = lambda v: ((v @ east[0]) / (v @ middle), (v @ north[0]) / (v @ middle))
    (x, y), poly, odd = flat(p), [flat(c) for c in corners], False
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_ear_clipping_keeps_the_area():
    draw = random.Random(2)
    for k in (3, 4, 7, 15):
        rings = np.stack([spatial.unit_vectors(*np.array(star(draw, 10, 20, k, 0.01)).T) for _ in range(20)])
        parts = spatial.ear_clip(rings)
        assert parts.shape == (20, k - 2, 3)
        east, north = spatial._tangents(spatial.unit_vectors(np.array([10.0]), np.array([20.0])))
        x, y = rings @ east[0], rings @ north[0]
        whole = abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(axis=1))
        tx, ty = np.take_along_axis(x[:, None], parts, 2), np.take_along_axis(y[:, None], parts, 2)
        each = abs((tx * np.roll(ty, -1, 2) - np.roll(tx, -1, 2) * ty).sum(axis=2)).sum(axis=1)
        assert np.allclose(whole, each, rtol=1e-3)


def test_hierarchy_misses_no_box():
    draw = np.random.default_rng(4)
    points = draw.normal(size=(400, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    base = draw.normal(size=(150, 1, 3))
    triangles = base + draw.normal(size=(150, 3, 3)) * 0.3
    triangles /= np.linalg.norm(triangles, axis=2, keepdims=True)
    who, which = spatial.candidates(points, triangles)
    low, high = spatial._boxes(triangles)
    wanted = {(i, j) for i in range(400) for j in range(150) if (points[i] >= low[j]).all() and (points[i] <= high[j]).all()}
    assert set(zip(who.tolist(), which.tolist(), strict=True)) == wanted and len(who) == len(wanted)


REGIONS = [(0, 0, 0.3), (89.5, 10, 0.1), (-88, -100, 0.2), (12, 179.9, 0.05), (45, 45, 0.001), (45.01, 45.01, 0.002), (-30, -60, 0.6)]


def test_points_in_regions(spark):
    draw = random.Random(8)
    rings = {f"r{i}": star(draw, lat, lon, draw.choice([3, 5, 9]), reach) for i, (lat, lon, reach) in enumerate(REGIONS)}
    places = []
    for lat, lon, reach in REGIONS:
        places += [star(draw, lat, lon, 4, reach * 1.5)[0] for _ in range(60)]
    places += [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(60)]
    regions = [(name, [{"lat": a, "lon": b} for a, b in ring]) for name, ring in rings.items()]
    regions += [("closed", [*regions[0][1], regions[0][1][0]]), ("thin", regions[0][1][:2]), ("none", None), ("bad", [*regions[0][1], {"lat": 95.0, "lon": 0.0}]), (None, regions[0][1])]
    r = spark.createDataFrame(regions, "region_id string, ring array<struct<lat: double, lon: double>>").withColumn("cell", F.lit("clash"))
    p = spark.createDataFrame([(f"p{i}", a, b) for i, (a, b) in enumerate(places)], "id string, lat double, lon double")
    got = [tuple(x) for x in spatial.within_regions(spatial.region_triangles(r), p, materialize).collect()]
    wanted = {(n, f"p{i}") for n, ring in [*rings.items(), ("closed", rings["r0"])] for i, (a, b) in enumerate(places) if inside(ring, a, b)}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 50


def test_shared_boundary_counts_once(spark):
    ring = [{"lat": a, "lon": b} for a, b in ((-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0))]
    r = spark.createDataFrame([("square", ring)], "region_id string, ring array<struct<lat: double, lon: double>>")
    p = spark.createDataFrame([("middle", 0.0, 0.0), ("corner", 1.0, 1.0), ("out", 1.1, 0.0)], "id string, lat double, lon double")
    assert sorted(tuple(x) for x in spatial.within_regions(spatial.region_triangles(r), p, materialize).collect()) == [("square", "corner"), ("square", "middle")]


def near(places, metres):
    wanted = set()
    for i, (a, la, lo) in enumerate(places):
        for b, lb, lp in places[:i]:
            if spatial.distance(np.array([la]), np.array([lo]), np.array([lb]), np.array([lp]))[0] <= metres:
                wanted.add((min(a, b), max(a, b)))
    return wanted


@pytest.mark.parametrize("block", [spatial.BLOCK, 7])
def test_near_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    draw, places = random.Random(9), []
    centres = [(90.0, 0.0), (-90.0, 50.0), (0.00001, 180.0), (35.0, -115.0), (0.0, 0.0003), (51.5, 0.0)]
    for i in range(300):
        lat, lon = draw.choice(centres)
        lat = max(-90.0, min(90.0, lat + draw.uniform(-0.003, 0.003)))
        lon = lon + draw.uniform(-180, 180) if abs(lat) > 89 else lon + draw.uniform(-0.003, 0.003)
        places.append((f"id{i}", lat, (lon + 180) % 360 - 180))
    places += [("same1", 35.0, -115.0), ("same2", 35.0, -115.0)]
    odd = [("zero", 0.0, 0.0), ("zero2", 0.0, 0.0), ("null", None, 1.0), ("range", 91.0, 0.0), ("nan", float("nan"), 1.0), (None, 35.0, -115.0)]
    df = spark.createDataFrame(places + odd, "id string, lat double, lon double").withColumn("shape", F.lit("clash"))
    got = [tuple(x) for x in spatial.near_pairs(df, 100.0, materialize).collect()]
    assert len(got) == len(set(got)) and set(got) == near(places, 100.0) and len(got) > 300


def test_no_places(spark):
    df = spark.createDataFrame([], "id string, lat double, lon double")
    assert spatial.near_pairs(df, 100.0, materialize).count() == 0


def test_large_polygons_and_holes_keep_the_area():
    draw = random.Random(5)
    for k in (17, 60, 2000):
        ring = np.array(star(draw, 10, 20, k, 0.01))
        began = time.time()
        corners = spatial.unit_vectors(*ring.T)[None]
        x, y = (v[0] for v in spatial._in_plane(corners))
        parts = spatial.ear_clip(corners)[0]
        area = lambda t: abs((x[t] * np.roll(y[t], -1, -1) - np.roll(x[t], -1, -1) * y[t]).sum(axis=-1)) / 2
        assert parts.shape == (k - 2, 3) and area(parts).sum() == pytest.approx(area(np.arange(k)), rel=1e-9) and time.time() - began < 20
    x = np.array([0, 10, 10, 0, 2, 4, 4, 2, 6, 8, 7, 2, 3, 3], float)
    y = np.array([0, 0, 10, 10, 2, 2, 4, 4, 6, 6, 8, 7, 7, 8], float)
    ring = spatial.bridged(x, y, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10], [11, 12, 13]])
    parts = spatial.clip_one(x, y, ring)
    each = abs((x[parts] * np.roll(y[parts], -1, 1) - np.roll(x[parts], -1, 1) * y[parts]).sum(axis=1)) / 2
    assert each.sum() == pytest.approx(100 - 4 - 2 - 0.5)


def test_regions_with_holes_and_shared_boundaries(spark):
    box = lambda a, b, c, d: [{"lat": float(la), "lon": float(lo)} for la, lo in ((a, b), (a, d), (c, d), (c, b))]
    ring = "array<struct<lat: double, lon: double>>"
    r = spark.createDataFrame([("b", box(0, 0, 2, 2), [box(0.5, 0.5, 1, 1), None]), ("a", box(0, 2, 2, 4), []), ("c", box(10, 10, 11, 11), None), ("c", box(20, 20, 21, 21), None)], f"region_id string, ring {ring}, holes array<{ring}>")
    p = spark.createDataFrame([("in", 1.5, 1.5), ("hole", 0.7, 0.7), ("border", 1.0, 2.0), ("part1", 10.5, 10.5), ("part2", 20.5, 20.5), ("out", 5.0, 5.0), ("null", None, 1.0)], "id string, lat double, lon double")
    assert sorted(tuple(x) for x in spatial.assign_regions(r, p, materialize).collect()) == [("border", "a"), ("in", "b"), ("part1", "c"), ("part2", "c")]


def test_a_crowded_spot_is_held_in_slices():
    draw = np.random.default_rng(3)
    centre = spatial.unit_vectors(10 + draw.uniform(0, 1e-4, 6000), 20 + draw.uniform(0, 1e-4, 6000))
    corners = spatial.hexagons(centre, 100.0)
    triangles = corners[np.arange(6000)[:, None, None], spatial.ear_clip(corners)].reshape(-1, 3, 3)
    largest = pairs = 0
    for who, which in spatial.Hierarchy(triangles).candidates(centre[:500]):
        assert len(who) == len(which)
        largest, pairs = max(largest, len(who)), pairs + len(who)
    assert pairs > 5_000_000 and largest <= spatial.PAIRS_HELD
