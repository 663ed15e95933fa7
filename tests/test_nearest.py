"""Nearest items by cells against a comparison of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varigrid.operators import coverage, nearest

NONE = float("nan")


def km(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, max(0.0, a))))


def gap(lon, lat, w, s, e, n):
    clip = lambda x, low, high: low if x < low else high if x > high else x
    return km(lat, lon, clip(lat, s, n), clip(lon, w, e))


def spots(draw, n):
    """Positions all over the globe, in a dense cluster, at the poles and beside the antimeridian."""
    out = [(draw.uniform(-180, 180), math.degrees(math.asin(draw.uniform(-1, 1)))) for _ in range(n)]
    out += [(20 + draw.gauss(0, 0.05), 40 + draw.gauss(0, 0.05)) for _ in range(n)]
    out += [(draw.uniform(-180, 180), draw.choice([-1, 1]) * (90 - draw.random())) for _ in range(n // 4)]
    out += [(draw.choice([-180, 180]) * (1 - 1e-4 * draw.random()), draw.uniform(-60, 60)) for _ in range(n // 4)]
    return [*out, (180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (0.0, -90.0)]


@pytest.mark.parametrize("met", [1, 8])
def test_nearest_scene_equals_all_pairs(spark, met, monkeypatch):
    monkeypatch.setattr(nearest.nearest, "__defaults__", (nearest.GLOBE, (), met, 9))
    draw = random.Random(3)
    scenes = [(f"s{i:04}", f"p{i}", *xy) for i, xy in enumerate(spots(draw, 60))]
    scenes += [(f"a{i}", "same place", *scenes[5][2:]) for i in range(30)] + [("x", "nowhere", None, 1.0), ("y", "nowhere", NONE, 1.0)]
    points = [(i, *xy) for i, xy in enumerate(spots(draw, 80))] + [(1000, *scenes[5][2:]), (1001, None, 3.0), (1002, 3.0, NONE)]
    frames = spark.createDataFrame(points, "p long, lon double, lat double"), spark.createDataFrame(scenes, "scene_id string, place string, lon double, lat double")
    got = {r["p"]: r for r in coverage.nearest_scene(*frames, key=["p"], compared=0).collect()}
    small = {r["p"]: r for r in coverage.nearest_scene(*frames, key=["p"]).collect()}
    assert len(got) == len(points) and got == small
    for p, lon, lat in points:
        if p > 1000:
            assert got[p]["nearest_scene_id"] is None and got[p]["nearest_scene_km"] is None
            continue
        best = min(km(lat, lon, y, x) for _, _, x, y in scenes if x is not None and x == x)
        assert got[p]["nearest_scene_km"] == pytest.approx(best, abs=1e-6)
    assert got[1000]["nearest_scene_id"] == "a0"


def test_rect_gap_equals_all_pairs(spark):
    draw = random.Random(4)
    feet = []
    for lon, lat in spots(draw, 40):
        wide, tall = draw.choice([(0.3, 0.2), (20.0, 10.0), (0.0, 0.0)])
        west, east = lon - wide / 2, lon + wide / 2
        feet.append((west, max(-90.0, lat - tall / 2), east - 360 if draw.random() < 0.1 and east > 180 else east, min(90.0, lat + tall / 2)))
    feet += [feet[0]] * 20 + [(None, 0.0, 1.0, 1.0)]
    points = [(i, *xy) for i, xy in enumerate(spots(draw, 60))] + [(999, None, None)]
    frames = spark.createDataFrame(points, "p long, lon double, lat double"), spark.createDataFrame(feet, "west double, south double, east double, north double")
    got = {r["p"]: r for r in coverage.rect_gap(*frames, key=["p"], compared=0).collect()}
    assert got == {r["p"]: r for r in coverage.rect_gap(*frames, key=["p"]).collect()} and len(got) == len(points)
    for p, lon, lat in points[:-1]:
        best = min(gap(lon, lat, *f) for f in feet[:-1])
        assert got[p]["km"] == pytest.approx(best, abs=1e-6) and got[p]["inside"] == (got[p]["km"] == 0)
    assert got[999]["km"] is None


def test_no_others_and_no_points(spark):
    scenes = spark.createDataFrame([], "scene_id string, place string, lon double, lat double")
    points = spark.createDataFrame([(1, 2.0, 3.0)], "p long, lon double, lat double")
    assert coverage.nearest_scene(points, scenes, key=["p"], compared=0).first()["nearest_scene_id"] is None
    one = spark.createDataFrame([("a", "b", 1.0, 1.0)], scenes.schema)
    assert coverage.nearest_scene(points.where("false"), one, key=["p"], compared=0).count() == 0


def test_a_point_meets_few_of_many_scenes(spark):
    """100,000 scenes, half of them in one cluster; points near, inside and far from it."""
    draw = np.random.default_rng(1)
    n, m = 100_000, 4000
    lon, lat = draw.uniform(-180, 180, n), np.degrees(np.arcsin(draw.uniform(-1, 1, n)))
    lon[: n // 2], lat[: n // 2] = 20 + draw.normal(0, 0.3, n // 2), 40 + draw.normal(0, 0.3, n // 2)
    px, py = draw.uniform(-180, 180, m), np.degrees(np.arcsin(draw.uniform(-1, 1, m)))
    px[:1000], py[:1000] = 23, 40 + draw.normal(0, 1, 1000)
    px[1000:2000], py[1000:2000] = 20 + draw.normal(0, 0.3, 1000), 40 + draw.normal(0, 0.3, 1000)
    at = lambda **c: nearest.placed(spark.createDataFrame(pd.DataFrame(c)), F.col("lon"), F.col("lat"))
    items = at(i=np.arange(n), lon=lon, lat=lat).drop("lon", "lat").withColumn("_r", F.lit(0.0))
    met = nearest.nearest(at(p=np.arange(m), lon=px, lat=py), items).select("p", "_items.i")
    unit = lambda x, y: np.stack([np.cos(np.radians(y)) * np.cos(np.radians(x)), np.cos(np.radians(y)) * np.sin(np.radians(x)), np.sin(np.radians(y))])
    best = (unit(px, py).T @ unit(lon, lat)).argmax(axis=1)
    rows = met.collect()
    assert len(rows) == m and all(best[r["p"]] in r["i"] for r in rows)
    assert max(len(r["i"]) for r in rows) <= nearest.MET and sum(len(r["i"]) for r in rows) < 30 * m
