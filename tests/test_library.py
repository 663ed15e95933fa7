"""Geometry, ledger, gates, sources and streams."""

from __future__ import annotations

import json
import math
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrid.config import GateConfig
from varigrid.functions import geo
from varigrid.functions.nulls import denan, ratio
from varigrid.operators import coverage, ledger
from varigrid.sources import cubes, tables
from varigrid.streaming import binning as streams

#: The sixteen published stations (name, weekly or not, latitude, longitude).
STATIONS = [
    ("WE02", 1, 41.762, -83.330), ("WE04", 1, 41.827, -83.193), ("WE06", 1, 41.705, -83.385), ("WE08", 1, 41.834, -83.364), ("WE09", 1, 41.718, -83.424), ("WE12", 1, 41.703, -83.254), ("WE13", 1, 41.741, -83.136), ("WE14", 1, 41.720, -83.010),
    ("WE15", 1, 41.617, -83.009), ("WE16", 1, 41.660, -83.143), ("THLO1", 0, 41.826, -83.194), ("45165", 0, 41.704, -83.264), ("45200", 0, 41.724, -83.370), ("45201", 0, 41.601, -82.781), ("45202", 0, 41.532, -82.941), ("45005", 0, 41.677, -82.398),
]


def temp(name: str) -> str:
    return f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{name}"


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_stations_in_the_proposed_box(spark):
    path = temp("stations.csv")
    with open(path, "w") as f:
        f.write("station,kind,lat,lon,depth_m,sampling,source\n")
        f.writelines(f'{n},{"weekly" if w else "buoy"},{lat},{lon},,"casts; samples, weekly","table, 1"\n' for n, w, lat, lon in STATIONS)
    frame = tables.stations(spark, path)
    assert frame.where("sampling = 'casts; samples, weekly' and depth_m is null").count() == 16
    assert tuple(coverage.stations_in_box(frame, -83.28 - 0.15, 41.80 - 0.10, -83.28 + 0.15, 41.80 + 0.10, "weekly").first()) == (16, 10, 7)


def test_geometry(spark):
    r = one(spark, geo.box_area_km2(-180, -90, 180, 90), geo.box_area_km2(170, 0, -170, 10), geo.box_area_km2(0, 0, 20, 10), geo.haversine_km(0, 0, 0, 180), geo.haversine_km(0, 0, 90, 0), geo.rect_gap_km(5, 5, 0, 0, 10, 10), geo.rect_gap_km(11, 5, 0, 0, 10, 10))
    assert r["c0"] == pytest.approx(510_065_621.7, abs=1) and r["c1"] == pytest.approx(r["c2"])
    assert r["c3"] == pytest.approx(math.pi * 6371) and r["c4"] == pytest.approx(math.pi * 6371 / 2)
    assert r["c5"] == 0 and r["c6"] == pytest.approx(6371 * math.radians(1) * math.cos(math.radians(5)), rel=1e-4)
    inside = one(spark, geo.in_box(180.0, 0.0, 179.0, -1.0, -179.0, 1.0), geo.in_box(-179.0, 1.0, 179.0, -1.0, -179.0, 1.0), geo.in_box(178.9, 0.0, 179.0, -1.0, -179.0, 1.0))
    assert tuple(inside) == (True, True, False)


def test_map_projection_round_trip(spark):
    frame = spark.createDataFrame([(float(lon), float(lat)) for lon in (-84, -81.5, -80) for lat in (-60, 0.5, 41.8, 75)], "lon double, lat double")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), 17)
    back = frame.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", *(c.alias(n) for c, n in zip(geo.utm_inverse(F.col("x"), F.col("y"), 17), ("lon2", "lat2"), strict=True)))
    assert all(abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9 for r in back.collect())
    e, n = one(spark, *geo.utm_forward(-81.0, 0.0, 17))
    assert e == pytest.approx(500_000) and n == pytest.approx(0, abs=1e-6)
    assert one(spark, geo.utm_zone(F.lit(-83.3)))[0] == 17


def test_projections_of_both_hemispheres_and_poles(spark):
    """Published examples of the polar stereographic projection, variants A and B, and the way back from every code."""
    e, n = one(spark, *geo.projected(44.0, 73.0, 32661))
    assert (e, n) == (pytest.approx(3_320_416.75, abs=0.01), pytest.approx(632_668.43, abs=0.01))
    e, n = one(spark, *geo.projected(50.0, -75.0, 3031))
    assert (e, n) == (pytest.approx(1_255_380.79, abs=0.01), pytest.approx(1_053_389.56, abs=0.01))
    north, south = one(spark, geo.projected(-58.0, 34.5, 32621)[1], geo.projected(-58.0, -34.5, 32721)[1])
    assert north + south == pytest.approx(10_000_000)
    places = [(code, lon, lat) for code in geo.POLAR for lon in (-179.5, -60.0, 0.0, 100.0, 180.0) for lat in (60.0, 84.5, 89.999)]
    places = [(code, lon, lat * geo.POLAR[code][0]) for code, lon, lat in places] + [(32733, 14.0, -33.9), (32633, 16.0, 71.0), (32760, 179.0, -0.5)]
    frame = spark.createDataFrame(places, "epsg int, lon double, lat double")
    x, y = geo.projected(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = geo.unprojected(F.col("x"), F.col("y"), F.col("epsg"))
    for r in frame.withColumns({"x": x, "y": y}).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lat"] - r["lat2"]) < 1e-9 and abs((r["lon"] - r["lon2"] + 180) % 360 - 180) < 1e-7, r
    for code in (32661, 32761):
        pole = 90.0 * geo.POLAR[code][0]
        e, n = one(spark, *geo.projected(12.0, pole, code))
        assert (e, n) == (2_000_000, 2_000_000)
        assert one(spark, geo.unprojected(e, n, code)[1])[0] == pole
    codes = one(spark, *(geo.epsg_for(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate([(-83.3, 41.8), (151.2, -33.9), (10.0, 84.1), (10.0, -80.1), (179.9, 0.0)])))
    assert tuple(codes) == (32617, 32756, 32661, 32761, 32660)
    assert tuple(one(spark, *geo.projected(1.0, 2.0, F.lit(None)))) == (None, None)
    with pytest.raises(Exception, match="unknown projection"):
        spark.range(1).select(geo.projected(1.0, 2.0, F.col("id").cast("int") + 4326)[0]).collect()


def test_grid_headers_of_other_projections(spark):
    table = {"dx": 30.0, "dy": -30.0, "x0": 300_000.0, "y0": 6_250_000.0, "n_x": 100, "n_y": 100}
    grids = {"south": tables.grid_header({**table, "epsg": 32756}), "pole": tables.grid_header({**table, "epsg": 3413, "x0": 0.0, "y0": 0.0}), "plain": tables.grid_header({**table, "zone": 17})}
    corners = {k: [(r["lon"], r["lat"]) for r in tables.corners_frame(spark, grids).where(F.col("scene") == k).collect()] for k in grids}
    assert all(150 < lon < 152 and -34.5 < lat < -33 for lon, lat in corners["south"]) and max(lat for _, lat in corners["pole"]) == 90
    assert grids["plain"].epsg == 32617
    with pytest.raises(ValueError, match="not a projection"):
        tables.grid_header({**table, "epsg": 4326})


def test_missing_values(spark):
    frame = spark.createDataFrame([(float("nan"), 1.0), (2.0, 0.0)], "a double, b double")
    rows = denan(frame).select("a", ratio(F.col("a"), F.col("b")).alias("q")).collect()
    assert [tuple(r) for r in rows] == [(None, None), (2.0, None)]


def test_ledger_is_idempotent_and_written_before_it_raises(spark):
    path = temp("verdicts")
    rows = [ledger.verdict_row("V1 a", "s", 'quoted "x", y', "t", "PASS"), ledger.verdict_row("V2 b", "s", "1", "t", "PASS")]
    ledger.record(spark, path, rows)
    ledger.record(spark, path, rows)
    with pytest.raises(RuntimeError, match="V2 c"):
        ledger.enforce(spark, path, [ledger.verdict_row("V2 c", "s", "2", "t", "FAIL")])
    got = spark.read.schema(ledger.SCHEMA).csv(path, header=True, escape='"').orderBy("hypothesis").collect()
    assert [(r["hypothesis"], r["verdict"]) for r in got] == [("V1 a", "PASS"), ("V2 c", "FAIL")] and got[0]["value"] == 'quoted "x", y'


def test_gates(spark):
    files = spark.createDataFrame([("a", True, 600), ("b", True, 20)], "scene string, opens boolean, n_valid int")
    assert ledger.fetch_gate(files, ["a"])["verdict"] == "PASS" and ledger.fetch_gate(files, ["a", "b", "c"])["note"] == "b, c"
    margins = spark.createDataFrame([(-0.0, 1.5)], "worst_shortfall_px double, widest_margin_px double")
    assert ledger.grid_gate(margins)["value"] == "0.00" and ledger.grid_gate(margins)["verdict"] == "PASS"
    checks = spark.createDataFrame([(0.5, 1.01)], "water_share double, green_over_nir double")
    assert ledger.water_gate(checks)["verdict"] == "FAIL" and ledger.water_gate(checks, GateConfig(min_green_over_nir=1.0))["verdict"] == "PASS"
    gates = spark.createDataFrame([("a", 0.8, 1.8), ("b", 0.9, 0.5)], "scene string, worst_correlation double, worst_spread double")
    assert ledger.agreement_verdict(gates)["value"] == "0.8; 0.5" and ledger.agreement_verdict(gates)["verdict"] == "PASS"
    scores = spark.createDataFrame([("a", True, 0.3), ("b", True, 0.8), ("c", False, None)], "scene string, assessable boolean, ratio double")
    assert [ledger.structure_verdict(scores.where(w), ["scene"])["verdict"] for w in ("true", "scene = 'a'", "scene = 'c'")] == ["MIXED", "PASS", "NOT ASSESSABLE"]
    noise = spark.createDataFrame([("a", 5.1), ("b", None)], "scene string, multiple double")
    assert ledger.noise_verdict(noise, ["scene"])["verdict"] == "PASS" and ledger.noise_verdict(noise.where("scene = 'b'"), ["scene"])["verdict"] == "FAIL"
    assert ledger.coverage_verdict(3, 10)["verdict"] == "PASS" and ledger.coverage_verdict(3, 10, 50.0, 100.0)["verdict"] == "FAIL"
    assert ledger.schema_check(files, {"scene": "string", "n_valid": "bigint", "x": "int"}) == ["n_valid is int, not bigint", "x is missing"]
    told = ledger.write_metrics(gates, temp("metrics.json"), ["scene"])
    assert told["a"]["worst_spread"] == 1.8


def test_inventory_keeps_ids(spark):
    path = temp("scenes.json")
    with open(path, "w") as f:
        json.dump([{"id": "20250914_171527_18_4001", "dt": "2025-09-14", "bbox": [1.0, 2.0, 3.0, 4.0], "loc": "here"}], f)
    r = tables.inventory(spark, path).first()
    assert (r["scene_id"], r["lon"], r["lat"]) == ("20250914_171527_18_4001", 2.0, 3.0)
    with open(path, "w") as f:
        f.write('[{"id": 20250914171527184001, "bbox": [1, 2, 3, 4]}]')
    with pytest.raises(Exception, match="number"):
        tables.inventory(spark, path).collect()
    with pytest.raises(TypeError):
        coverage.string_ids(spark.range(1), "id")


def test_configured_scenes(spark):
    entry = {"scene_id": "2025_1_4001", "date": "2025-05-14", "bbox": [0, 1, 2, 3], "search_bbox": [0, 1, 2, 3], "role": "a\n  b", "more": "x"}
    scenes = tables.load_scenes({"b": entry, "a": entry}, ["a"])
    assert scenes[0].key == "a" and scenes[0].role == "a b" and scenes[0].extra == (("more", "x"),)
    assert tables.scenes_frame(spark, scenes).first()["scene_id"] == "2025_1_4001"
    with pytest.raises(KeyError):
        tables.load_scenes({"a": entry}, ["z"])
    with pytest.raises(TypeError):
        tables.load_scenes({"a": entry | {"scene_id": 20251}})


def test_index_cache(spark):
    full, subset = temp("full"), temp("subset")
    spark.createDataFrame([(1, 1.0, 2.0, "2024-01-01 00:00:00", "TEMP CHLA", "x"), (2, float("nan"), 2.0, "2024-01-01", None, "x"), (3, 1.0, 2.0, "no date", "CHLA", "x"), (4, 1.0, 2.0, "2024-01-02", None, "x")], "PLATFORM_NUMBER int, LATITUDE double, LONGITUDE double, TIME string, parameters string, other string").write.parquet(full)
    rows = tables.load_index(spark, subset, full).orderBy("float_id").collect()
    assert [(r["float_id"], r["has_chla"]) for r in rows] == [("1", True), ("4", False)]
    assert tables.load_index(spark, subset).count() == 2 and "other" not in spark.read.parquet(subset).columns
    with pytest.raises(FileNotFoundError):
        tables.load_index(spark, temp("none"))


def test_aggregates_by_partition(spark):
    path = temp("agg")
    frame = spark.createDataFrame([("a", "olci", float("nan")), ("b", "pace", 2.0)], "scene string, sensor string, v double")
    tables.write_aggregates(frame, path)
    tables.write_aggregates(frame.where("scene = 'b'").withColumn("v", F.lit(3.0)), path)
    assert {(r["scene"], r["v"]) for r in tables.aggregates(spark, path).collect()} == {("a", None), ("b", 3.0)}


def test_cube_source(spark):
    path = temp("cube.npy")
    cube = np.arange(2 * 5 * 3, dtype=np.float32).reshape(2, 5, 3)
    cube[:, 4, 2] = -9999
    cube[0, 0, 0] = np.nan
    np.save(path, cube)
    cubes.register(spark)
    frame = spark.read.format("npycube").option("path", path).option("rows", "2").load()
    rows = {(r["row"], r["col"]): r for r in frame.collect()}
    assert len(rows) == 15 and frame.rdd.getNumPartitions() == 3
    assert rows[0, 0]["sr"] == [None, 15.0] and not rows[4, 2]["valid"] and rows[1, 2]["sr"] == [5.0, 20.0]
    assert (rows[0, 0]["x"], rows[0, 0]["y"]) == (15.0, -15.0) and rows[0, 0]["scene"] == "cube"
    some = frame.where("row > 1 and row <= 3 and x between 40 and 80 and y < -100 and sr[0] > 9")
    assert {(r["row"], r["col"]) for r in some.collect()} == {(3, 1), (3, 2)} and some.rdd.getNumPartitions() == 1
    assert frame.where("row in (0, 4)").rdd.getNumPartitions() == 2 and frame.where("scene = 'other'").count() == 0
    one = spark.read.format("npycube").schema("b1 float, col int").option("path", path).load()
    assert sorted(r["b1"] for r in one.where("col = 1").collect()) == [16.0, 19.0, 22.0, 25.0, 28.0]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("npycube").schema("nir float").option("path", path).load().collect()


def test_cube_folder_reads_only_what_is_asked_for(spark):
    path = temp("scene_a")
    cells = spark.createDataFrame([(r, c, float(r * 10 + c), None if r == 3 else 1.0) for r in range(8) for c in range(6) if r != 5], "row int, col int, g double, n double")
    cubes.write_cube(cells, path, ["g", "n"], 9, 6, rows=4)
    cubes.register(spark)
    read = spark.read.format("npycube").schema("scene string, row int, col int, b0 float, b1 float").option("path", path).load()
    got = {(r["row"], r["col"]): (r["b0"], r["b1"]) for r in read.collect()}
    assert len(got) == 54 and got[3, 2] == (32.0, None) and got[5, 1] == (None, None) and got[8, 0] == (None, None)
    os.remove(f"{path}/strip-00000004.npy")  # a strip outside the window is never opened
    window = read.where("row < 3 and col >= 4 and scene = 'scene_a'")
    assert {(r["row"], r["col"]) for r in window.collect()} == {(r, c) for r in range(3) for c in (4, 5)}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", ""), plan  # all comparisons went to the scan


def test_swath_source(spark):
    base = temp("swaths")
    cells = [(g, i, j, 40.0 + i, -80.0 - j, None if (i, j) == (1, 1) else i * 10.0 + j, 5.0) for g in "ab" for i in range(6) for j in range(3) if (i, j) != (5, 2)]
    frame = spark.createDataFrame(cells, "granule string, line int, pixel int, lat double, lon double, Rrs_490 double, chlor_a double")
    paths = cubes.write_swath(frame, base, ["Rrs_490", "chlor_a"], 6, 3)
    cubes.register(spark)
    swath = spark.read.format("npyswath").option("path", ",".join(paths)).option("rows", "2").load()
    assert swath.columns == ["granule", "line", "pixel", "coarse_index", "lat", "lon", "Rrs_490", "chlor_a"]
    rows = {(r["granule"], r["line"], r["pixel"]): r for r in swath.collect()}
    assert len(rows) == 36 and rows["b", 1, 1]["Rrs_490"] is None and rows["a", 5, 2]["lat"] is None and rows["a", 2, 1]["coarse_index"] == 7
    near = swath.where("granule = 'b' and lat >= 42 and lat < 44 and lon < -80.5")
    assert {(r["line"], r["pixel"]) for r in near.collect()} == {(2, 1), (2, 2), (3, 1), (3, 2)} and near.rdd.getNumPartitions() == 3
    assert swath.where("lat is not null").count() == 34
    os.remove(f"{paths[1]}/geophysical_data/chlor_a.npy")  # retrievals of blocks without a position in bounds, or not asked for, stay unread
    less = spark.read.format("npyswath").schema("line int, lat double, Rrs_490 double").option("path", paths[1]).load()
    assert less.where("lat > 44.5").count() == 2 and swath.where("granule = 'b' and lat > 90").count() == 0


def test_streams(spark):
    source = temp("in")
    frame = spark.createDataFrame([(i % 3, float(i), f"2024-01-0{1 + i % 2} 00:00:{i:02d}", i % 5) for i in range(60)], "k int, v double, t string, id int").withColumn("t", F.to_timestamp("t"))
    frame.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = streams.stream_moments(stream, ["k"], "v").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", temp("c1")).start()
    query.awaitTermination(120)
    got = {r["k"]: (r["n"], round(r["mean"], 9), round(r["std"], 9)) for r in spark.table("moments").collect()}
    want = {k: np.arange(k, 60, 3.0) for k in range(3)}
    assert got == {k: (len(v), round(v.mean(), 9), round(v.std(), 9)) for k, v in want.items()}
    query = streams.stream_distinct(stream, ["k"], "id", "t", "10 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", temp("c2")).start()
    query.awaitTermination(120)
    assert spark.table("firsts").groupBy("k").count().where("count = 5").count() == 3


def test_ledger_versions(spark):
    """Writers at the same time, a broken write, and a ledger that stood there before."""
    path = temp("versions")
    spark.createDataFrame([("A old", "s", "1", "t", "PASS", "")], ledger.SCHEMA).write.csv(path, header=True)
    tags = [f"T{i}" for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda t: ledger.record(spark, path, [ledger.verdict_row(f"{t} x", "s", "1", "t", "PASS", 'a "note", and\nmore')]), tags))
    assert sorted(r["hypothesis"] for r in ledger.verdicts(spark, path).collect()) == ["A old", *(f"{t} x" for t in tags)]
    assert sorted(n for n in os.listdir(f"{path}/_versions") if not n.startswith(".")) == [f"{i:08d}.csv" for i in range(1, 7)]
    with open(f"{path}/_versions/.broken", "w") as f:
        f.write("hypothesis\nhalf a li")
    ledger.record(spark, path, [ledger.verdict_row("T3 y", "s", "2", "t", "FAIL")])
    rows = {r["hypothesis"]: (r["verdict"], r["note"]) for r in ledger.verdicts(spark, path).collect()}
    assert rows["T3 y"] == ("FAIL", "") and "T3 x" not in rows and rows["T1 x"] == ("PASS", 'a "note", and\nmore') and len(rows) == 7
    shown = spark.read.schema(ledger.SCHEMA).csv(path, header=True, multiLine=True, escape='"').fillna("")
    assert sorted(map(str, shown.collect())) == sorted(map(str, ledger.verdicts(spark, path).collect()))
    assert ledger.verdicts(spark, temp("none")).count() == 0
