"""The density search against dictionaries, on a wrapping and a bounded map."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from varigrid.config import SearchConfig
from varigrid.operators import density


def brute(points, config: SearchConfig) -> dict[tuple[int, int], set]:
    g = density.Lattice.of(config)
    out: dict[tuple[int, int], set] = {}
    for who, lon, lat in points:
        if who is None or lon is None or lat is None:
            continue
        x = min(max(int((lon - config.bounds[0]) // config.cell_deg), 0), g.n_lon - 1)
        y = min(max(int((lat - config.bounds[1]) // config.cell_deg), 0), g.n_lat - 1)
        for dy in range(g.win_y):
            for dx in range(g.win_x):
                ay, ax = y - dy, x - dx
                if g.wraps:
                    ax %= g.n_lon
                if 0 <= ay <= g.n_lat - g.win_y and ax >= 0:
                    out.setdefault((ay, ax), set()).add(who)
    return out


@pytest.mark.parametrize("bounds", [(-180.0, -90.0, 180.0, 90.0), (-8.0, -8.0, 8.0, 8.0)])
def test_windows_and_greedy_choice(spark, bounds):
    draw = random.Random(2)
    config = SearchConfig(box_deg=(3.0, 2.0), cell_deg=1.0, top_n=6, min_separation_deg=3.0, bounds=bounds)
    span = 8 if bounds[0] == -8 else 180
    points = [(draw.randrange(25), draw.randrange(-span, span) + 0.5, draw.randrange(-8, 8) + 0.5) for _ in range(600)] + [(None, 0.5, 0.5), (3, None, 0.5), (30, 180.0, 0.5), (31, -179.5, 0.5)]
    frame = spark.createDataFrame(points, "float_id long, lon double, lat double")
    want = {k: len(v) for k, v in brute(points, config).items()}
    got = {(r["anchor_y"], r["anchor_x"]): r["n_ids"] for r in density.distinct_id_windows(frame, config).collect()}
    assert got == want
    grid = density.Lattice.of(config)
    chosen: list[tuple[int, int]] = []
    for y, x in sorted(want, key=lambda k: (-want[k], k[0] * grid.n_lon + k[1])):
        near = lambda p: abs(y - p[0]) < 3 and min(abs(x - p[1]), grid.n_lon - abs(x - p[1]) if grid.wraps else 10**9) < 3  # noqa: E731, B023
        if len(chosen) < config.top_n and not any(map(near, chosen)):
            chosen.append((y, x))
    boxes = density.top_boxes(frame, config).orderBy("rank").collect()
    assert [(round(r["lat_min"] - bounds[1]), round((r["lon_west"] - bounds[0]))) for r in boxes] == chosen
    assert [r["score"] for r in boxes] == [want[c] for c in chosen]


def test_rotation_by_whole_cells_changes_nothing(spark):
    config = SearchConfig(box_deg=(3.0, 2.0), cell_deg=1.0)
    frame = spark.createDataFrame([(i % 7, (i * 37) % 360 - 179.5, (i * 11) % 60 - 29.5) for i in range(300)], "float_id long, lon double, lat double")
    turned = frame.withColumn("lon", F.when(F.col("lon") + 50 > 180, F.col("lon") - 310).otherwise(F.col("lon") + 50))
    counts = [sorted(r["n_ids"] for r in density.distinct_id_windows(f, config).collect()) for f in (frame, turned)]
    assert counts[0] == counts[1]


def test_bad_boxes_and_few_points(spark):
    frame = spark.createDataFrame([(3, 179.95, 0.05), (1, -179.95, 0.05), (2, -179.95, 0.05)], "float_id long, lon double, lat double")
    with pytest.raises(ValueError):
        density.top_boxes(frame, SearchConfig(box_deg=(0.25, 0.2), cell_deg=0.1))
    with pytest.raises(ValueError):
        density.top_boxes(frame, SearchConfig(box_deg=(1.0, 3.0), cell_deg=1.0, bounds=(0.0, 0.0, 5.0, 2.0)))
    rows = density.top_boxes(frame, SearchConfig(box_deg=(0.3, 0.2), cell_deg=0.1, top_n=5, min_separation_deg=2.0)).collect()
    assert len(rows) == 1 and rows[0]["wraps"] and (rows[0]["n_points"], rows[0]["n_ids"]) == (3, 3)
    boxes = density.top_boxes(frame.where("false"))
    assert boxes.count() == 0


def test_descriptions_keep_empty_and_wrapping_boxes(spark):
    boxes = spark.createDataFrame([(1, 179.9, -179.8, -1.0, 1.0), (2, 10.0, 11.0, 0.0, 1.0)], "rank int, lon_west double, lon_east double, lat_min double, lat_max double")
    points = spark.createDataFrame([("a", 179.95, 0.0, "2024-01-01", True), ("b", -179.9, 1.0, "2022-01-01", False), ("b", 0.0, 0.0, "2024-01-01", True)], "float_id string, lon double, lat double, time string, has_chla boolean")
    rows = {r["rank"]: r for r in density.describe_boxes(boxes, points, F.col("time") >= "2023").collect()}
    assert (rows[1]["flagged_points"], rows[1]["flagged_ids"], rows[1]["recent_points"], rows[1]["first_seen"]) == (1, 1, 1, "2022-01-01")
    assert rows[2]["flagged_points"] == 0 and rows[2]["first_seen"] is None


def test_runs_are_few_and_apart(spark):
    """Windows of 6 x 4 cells over a busy place: rows before the count fall by the window's width or more."""
    draw = random.Random(6)
    config = SearchConfig(box_deg=(6.0, 4.0), cell_deg=1.0)
    points = [(draw.randrange(5), draw.randrange(-180, -150) + 0.5, draw.randrange(-12, 12) + 0.5) for _ in range(4000)] + [(9, 179.5, 3.5), (9, -179.5, 3.5), (9, 0.5, 89.5), (9, 0.5, -89.5)]
    frame = spark.createDataFrame(points, "float_id long, lon double, lat double")
    want = {k: len(v) for k, v in brute(points, config).items()}
    assert {(r["anchor_y"], r["anchor_x"]): r["n_ids"] for r in density.distinct_id_windows(frame, config).collect()} == want
    runs = density._runs(frame, config, "float_id", "lon", "lat", [])
    cells = len({p for p in points})
    assert runs.count() < cells * 24 / 12 and runs.agg(F.sum(F.col("_to") - F.col("_from") + 1)).first()[0] == sum(want.values())
