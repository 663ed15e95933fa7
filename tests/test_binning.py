"""Nearest-centre joins, moments and variance splits against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrid.operators import agreement, binning, nearest, spectral, variance


def test_nearest_join_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    points, centres = draw.uniform(-50, 50, (2000, 2)), draw.uniform(-50, 50, (300, 2))
    centres[7] = centres[3]
    p = spark.createDataFrame([(i, *map(float, xy)) for i, xy in enumerate(points)] + [(9999, float("nan"), 0.0)], "p long, x double, y double")
    c = spark.createDataFrame([(i, *map(float, xy)) for i, xy in enumerate(centres)] + [(500, None, 1.0)], "coarse_index long, cx double, cy double")
    got = {r["p"]: r["coarse_index"] for r in binning.nearest_join(p, c, 4.0).collect()}
    d = np.sqrt(((points[:, None] - centres) ** 2).sum(2))
    want = {i: int(d[i].argmin()) for i in range(len(points)) if d[i].min() <= 4.0}
    assert got == want


def test_nearest_join_ties_and_reach(spark):
    p = spark.createDataFrame([(1, 0.5, 0.0), (2, 2.0, 0.0), (3, 2.0001, 0.0)], "p long, x double, y double")
    c = spark.createDataFrame([(8, 0.0, 0.0), (5, 1.0, 0.0)], "coarse_index long, cx double, cy double")
    assert {r["p"]: r["coarse_index"] for r in binning.nearest_join(p, c, 1.0).collect()} == {1: 5, 2: 5}


def test_median_spacing(spark):
    draw = np.random.default_rng(5)
    xy = draw.uniform(0, 30, (200, 2))
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(2)) + np.where(np.eye(200), np.inf, 0)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in xy], "x double, y double")
    r = binning.median_spacing(frame, reach=30.0).first()
    assert r["spacing"] == pytest.approx(np.median(d.min(1))) and r["n_alone"] == 0
    assert binning.median_spacing(frame, reach=0.5).first()["n_alone"] == int((d.min(1) > 0.5).sum())


def test_spacings_compute_their_centres_once(spark):
    """A centre may come from thousands of samples: these are read once, not by each step."""
    samples = spark.range(3000)
    for of in (lambda c: binning.median_spacing(c, reach=2.0), lambda c: binning.granule_spacing(c, ["k"])):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        one = samples.mapInArrow(counted, "id long")
        centres = one.groupBy(F.pmod("id", F.lit(300)).alias("i")).agg(F.lit(1).alias("k")).select("k", F.pmod("i", F.lit(20)).cast("double").alias("x"), F.floor(F.col("i") / 20).cast("double").alias("y"))
        assert of(centres).first()["spacing"] == 1.0
        assert read.value == 3000


def test_moments_ignore_what_is_not_finite(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", 3.0), ("b", None), ("c", 2.0), ("d", 0.0)], "k string, v double")
    rows = {r["k"]: (r["n"], r["mean"], r["std"]) for r in binning.bin_moments(frame, ["k"], "v").collect()}
    assert rows == {"a": (2, 2.0, 1.0), "b": (0, None, None), "c": (1, 2.0, 0.0), "d": (1, 0.0, 0.0)}
    assert spark.range(1).select(binning.within_cv(F.lit(0.0), F.lit(1.0)).alias("cv")).first()["cv"] is None


def test_array_moments_equal_column_moments(spark):
    frame = spark.createDataFrame([(1, 0.1, 0.5), (1, 0.3, None), (2, float("nan"), 0.7)], "k int, a double, b double")
    by_column = binning.band_moments(frame, ["k"], {500.0: "a", 950.0: "b"}, 400, 900)
    by_array = binning.array_moments(frame.select("k", F.array("a", "b").alias("sr")), ["k"], "sr", [500.0, 950.0], 400, 900)
    assert sorted(map(str, by_column.collect())) == sorted(map(str, by_array.collect()))


def test_ranks_over_buckets(spark):
    frame = spark.createDataFrame([(i * 7919 % 101,) for i in range(101)], "v long")
    rows = binning.bucket_rank(frame, F.floor(F.col("v") / 10), [F.col("v")], "rank").collect()
    assert all(r["v"] == r["rank"] for r in rows) and len(rows) == 101


@pytest.mark.parametrize("factor", [1, 3, 4])
def test_variance_identity(spark, factor):
    draw = np.random.default_rng(6)
    grid = draw.normal(0, 1, (14, 13)) + np.arange(13)
    grid[draw.random(grid.shape) < 0.3] = np.nan
    frame = spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(14) for c in range(13)], "r long, c long, v double")
    got = variance.variance_split(frame, "r", "c", "v", [factor], 14, 13).first()
    part = grid[: 14 // factor * factor, : 13 // factor * factor]
    assert got["total"] == pytest.approx(np.nanvar(part)) and got["n"] == np.isfinite(part).sum()
    assert got["between"] + got["within"] == pytest.approx(got["total"])
    if factor > 1:
        shaped = part.reshape(14 // factor, factor, -1, factor)
        n = np.isfinite(shaped).sum((1, 3))
        m = np.nansum(shaped, (1, 3)) / np.maximum(n, 1)
        assert got["between"] == pytest.approx((n * (m - np.nanmean(part)) ** 2).sum() / n.sum())


def test_ladder_leaves_flat_and_small_fields_out(spark):
    frame = spark.createDataFrame([(r, c, 1.0, float(r * c)) for r in range(25) for c in range(25)], "r long, c long, flat double, v double")
    rows = variance.variance_ladder(frame, "r", "c", {"flat": "flat", "v": "v"}, [5], 25, 25).collect()
    assert [r["scalar"] for r in rows] == ["v"]
    assert variance.variance_ladder(frame.where("r < 5"), "r", "c", {"v": "v"}, [5], 25, 25).count() == 0


def test_opening_and_threshold(spark):
    grid = np.zeros((9, 9), bool)
    grid[1:6, 1:6] = True
    grid[7, 7] = True
    frame = spark.createDataFrame([(r, c, bool(grid[r, c])) for r in range(9) for c in range(9)], "r long, c long, m boolean")
    got = {(r["r"], r["c"]) for r in spectral.binary_opening(frame, "r", "c", "m").collect()}
    eroded = {(r, c) for r in range(1, 8) for c in range(1, 8) if all(grid[r + a, c + b] for a, b in spectral.CROSS)}
    assert got == {(r + a, c + b) for r, c in eroded for a, b in spectral.CROSS}
    two = spark.createDataFrame([(0.1 + 0.001 * (i % 10),) for i in range(100)] + [(0.8,)] * 60, "v double")
    assert 0.1 < spectral.otsu_threshold(two, "v", 0.0, 1.0, 50).first()["threshold"] <= 0.8


@pytest.mark.parametrize("height, width", [(1, 1), (3, 4), (15, 15), (1, 9), (20, 2)])
def test_opening_by_a_rectangle_over_tiles(spark, height, width):
    """Blobs and pricks across tile edges and negative places, two scenes at once, against every offset tried."""
    rng = np.random.default_rng(height * 31 + width)
    grids = {}
    for scene in "ab":
        grid = rng.random((150, 140)) > 0.004
        for r, c in rng.integers(0, 120, (12, 2)):
            grid[r : r + 9, c : c + 30] = False
        grids[scene] = grid
    rows = [(s, int(r) - 40, int(c) - 7, bool(g[r, c]) or None) for s, g in grids.items() for r, c in np.ndindex(g.shape)]
    frame = spark.createDataFrame(rows, "s string, r int, c int, m boolean")
    opened = spectral.box_opening(frame, "r", "c", "m", height, width, ["s"])
    got = [(x["s"], x["r"], x["c"]) for x in opened.collect()]
    want = set()
    for s, g in grids.items():
        shape = (g.shape[0] - height + 1, g.shape[1] - width + 1)
        begin = np.all([g[a : a + shape[0], b : b + shape[1]] for a in range(height) for b in range(width)], axis=0)
        out = np.zeros_like(g)
        for a in range(height):
            for b in range(width):
                out[a : a + shape[0], b : b + shape[1]] |= begin
        want |= {(s, int(r) - 40, int(c) - 7) for r, c in np.argwhere(out)}
    assert set(got) == want and len(got) == len(want) > 0
    plan = opened._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1


def test_opening_of_nothing(spark):
    empty = spark.createDataFrame([], "r int, c int, m boolean")
    assert spectral.box_opening(empty, "r", "c", "m", 3, 3).count() == 0
    with pytest.raises(ValueError):
        spectral.box_opening(empty, "r", "c", "m", 0, 3)


def test_water_mask_with_a_rectangle(spark):
    cells = spark.createDataFrame([(r, c, 0.5 if 2 <= r < 8 and 2 <= c < 8 or (r, c) == (10, 10) else 0.1, 0.2) for r in range(12) for c in range(12)], "r int, c int, g double, n double")
    wet = {(x["r"], x["c"]) for x in spectral.water_mask(cells, "r", "c", "g", "n", element=(4, 4)).where("water").collect()}
    assert wet == {(r, c) for r in range(2, 8) for c in range(2, 8)}


def test_agreement_needs_pairs_and_positive_spread(spark):
    rows = [(float(i), 2.0 * i, -1.0 * i) for i in range(30)]
    frame = spark.createDataFrame(rows, "c double, t double, u double")
    both = agreement.spectral_agreement(frame, {490.0: "t", 561.0: "u"}, {490.0: "c", 560.0: "c", 700.0: "c"})
    stats = {r["wavelength_nm"]: (round(r["correlation"], 6), round(r["slope"], 6)) for r in both.collect()}
    assert stats == {490.0: (1.0, 2.0), 560.0: (-1.0, -1.0)}
    gate = agreement.agreement_gate(both).first()
    assert gate["worst_correlation"] == pytest.approx(-1) and gate["worst_spread"] == pytest.approx(2) and not gate["passes"]
    assert agreement.pair_stats(frame.limit(19), "t", "c").count() == 0
    with pytest.raises(KeyError):
        agreement.first_column(frame, ["coarse_a"])


def test_spacing_of_any_scale_in_one_call(spark):
    """Granules from 1 m to 5 km, one with both, repeated places and a lone centre, against all pairs."""
    draw = np.random.default_rng(9)
    at = {"fine": draw.uniform(0, 40, (400, 2)), "coarse": draw.uniform(0, 9e4, (300, 2)) + 5e6, "lone": np.array([[1.0, 2.0]]), "line": np.stack([np.arange(50.0), np.zeros(50)], 1)}
    at["both"] = np.concatenate([draw.uniform(0, 20, (300, 2)), draw.uniform(0, 2e6, (200, 2))])
    at["same"] = np.repeat([[3.0, 4.0]], 30, axis=0)
    at["twice"] = np.concatenate([at["fine"][:90], at["fine"][:40]])
    rows = [(k, float(a), float(b)) for k, xy in at.items() for a, b in xy] + [("fine", None, 1.0), ("fine", float("nan"), 1.0)]
    frame = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r["spacing"] for r in binning.granule_spacing(frame, ["k"]).collect()}
    assert set(got) == set(at) - {"lone"}
    for k in got:
        d = np.sqrt(((at[k][:, None] - at[k]) ** 2).sum(2)) + np.where(np.eye(len(at[k])), np.inf, 0)
        assert got[k] == pytest.approx(np.median(d.min(1)), rel=1e-9, abs=1e-12), k


def test_a_dense_region_fills_no_bucket(spark):
    """A thousandth of the area holds nearly all centres: each still meets few."""
    n = 60_000
    some = spark.range(n).select(F.pmod("id", F.lit(240)).cast("double").alias("x"), F.floor(F.col("id") / 240).cast("double").alias("y"))
    wide = spark.range(400).select((F.pmod("id", F.lit(20)) * 5000 + 1000).cast("double").alias("x"), (F.floor(F.col("id") / 20) * 5000 + 1000).cast("double").alias("y"))
    own = nearest.flat(some.unionByName(wide), "x", "y", [])
    met = nearest.nearest(own, own, nearest.PLANE).select("x", F.size("_items").alias("k"))
    worst = met.agg(F.count("k").alias("n"), F.max("k").alias("most"), F.avg("k").alias("mean")).first()
    assert worst["n"] == n + 400 and worst["most"] <= nearest.MET and worst["mean"] < 40
