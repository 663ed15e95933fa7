"""Window operators against dense numpy arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrid.config import BoxConfig
from varigrid.functions.permutations import permuted
from varigrid.operators import windows2d


def dense_cv(grid: np.ndarray, k: int, least: float, iterations: int = 1) -> dict[tuple[int, int], float | None]:
    out = {}
    for r in range(grid.shape[0] - k + 1):
        for c in range(grid.shape[1] - k + 1):
            box = grid[r : r + k, c : c + k].ravel()
            v = box[np.isfinite(box)]
            if not len(v):
                continue
            n = len(v)
            for _ in range(iterations):
                s = 0.0 if v.min() == v.max() else v.std()
                v = v if s == 0 else v[np.abs(v - v.mean()) <= 1.5 * s]
            s = 0.0 if v.min() == v.max() else v.std()
            out[r, c] = s / abs(v.mean()) if n / k**2 >= least and v.mean() != 0 else None
    return out


def cells(spark, grid: np.ndarray):
    rows = [(int(r), int(c), float(grid[r, c])) for r in range(grid.shape[0]) for c in range(grid.shape[1]) if not (np.isnan(grid[r, c]) and (r + c) % 2)]
    return spark.createDataFrame(rows, "r long, c long, v double")  # some missing cells are absent, others NaN


@pytest.mark.parametrize("iterations", [1, 3])
def test_box_cv_across_tiles(spark, iterations):
    draw = np.random.default_rng(1)
    grid = draw.normal(5, 2, (37, 70))
    grid[draw.random(grid.shape) < 0.4] = np.nan
    grid[:8, :8] = 3.3  # windows of one value
    grid[20:26, 30:36] = 0.0  # a mean of 0
    want = dense_cv(grid, 5, 0.5, iterations)
    rows = windows2d.box_cv(cells(spark, grid), "r", "c", "v", 37, 70, BoxConfig(iterations=iterations)).collect()
    got = {(r["anchor_row"], r["anchor_col"]): r["cv"] for r in rows if r["valid_fraction"] > 0}
    assert got.keys() == want.keys()
    for key, cv in want.items():
        assert (got[key] is None) == (cv is None) and (cv is None or abs(got[key] - cv) < 1e-9), key


def test_one_exchange_by_tile(spark):
    """The grouping of windows needs no exchange beyond the one by tile."""
    frame = spark.range(100).selectExpr("id % 10 AS r", "id div 10 AS c", "double(id) AS v")
    plan = windows2d.box_cv(frame, "r", "c", "v", 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoop" not in plan


def test_small_grids_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, 0, 1.0)], "r long, c long, v double")
    assert windows2d.box_cv(frame, "r", "c", "v", 4, 4).count() == 0  # no window fits
    assert windows2d.sliding_box(frame.where("false"), "r", "c", "v", 9, 9).count() == 0


def test_homogeneity_drops_boxes_without_a_centre(spark):
    grid = [(r, c, 1.0 + (r * c % 3) / 100, 1.0, 0.1 * (r + 1), 0.5, 0.05, 0.95) for r in range(6) for c in range(6) if (r, c) != (2, 2)]
    frame = spark.createDataFrame(grid, "r long, c long, f double, m double, w double, bm double, bs double, frac_water double")
    rows = windows2d.homogeneity_table(frame, "r", "c", 6, 6, filter_on="f", mean="m", within="w", band_mean="bm", band_std="bs").collect()
    assert {(r["anchor_row"], r["anchor_col"]) for r in rows} == {(0, 1), (1, 0), (1, 1)}
    assert all(r["passes_filter"] for r in rows)
    assert next(r["box_max_within_pixel_cv"] for r in rows if r["anchor_row"] == 1) == pytest.approx(0.6)
    few = windows2d.homogeneity_table(frame, "r", "c", 6, 6, filter_on="f", mean="m", within="w", band_mean="bm", band_std="bs", config=BoxConfig(min_water_fraction=0.96))
    assert few.count() == 0


def test_summary_counts_missing_values_as_false(spark):
    boxes = spark.createDataFrame([("a", True, 0.1, 0.2, 0.1, 0.2, 0.3, None), ("a", True, 0.1, None, 0.1, 0.2, 0.1, 0.4), ("a", False, 0.3, 0.2, 0.1, 0.2, 0.9, 0.9)], "scene string, passes_filter boolean, between_pixel_cv double, fine_between_pixel_cv double, band_between_pixel_cv double, band_centre_within_pixel_cv double, centre_within_pixel_cv double, box_max_within_pixel_cv double")
    r = windows2d.box_summary(boxes, ["scene"]).first()
    assert (r["n_boxes"], r["n_passing"], r["n_like_for_like"], r["n_band"]) == (3, 2, 1, 2)
    assert r["frac_any_above"] == 0.5 and r["frac_centre_above"] == 0.5 and r["within_over_between"] == pytest.approx(1.5)


def test_shuffle_permutes_and_structure_shows(spark):
    rows = [(s, r, c, float(r * 50 + c)) for s in ("a", "b") for r in range(20) for c in range(20) if (r + c) % 7]
    frame = spark.createDataFrame(rows, "scene string, r long, c long, v double")
    mixed = windows2d.shuffled(frame, "r", "c", "v", ["scene"], seed=4).collect()
    assert sorted((r["scene"], r["r"], r["c"]) for r in mixed) == sorted((s, r, c) for s, r, c, _ in rows)
    assert sorted((r["scene"], r["v"]) for r in mixed) == sorted((s, v) for s, _, _, v in rows)
    scores = windows2d.structure_score(frame, "r", "c", "v", ["scene"]).collect()
    assert len(scores) == 2 and all(r["assessable"] and r["ratio"] < 0.2 for r in scores)
    few = windows2d.structure_score(frame.where("r < 2"), "r", "c", "v", ["scene"]).first()
    assert not few["assessable"] and few["ratio"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 226, 1000, 30_011])
def test_permutation_is_a_bijection(spark, n):
    at = lambda seed: [r["p"] for r in spark.range(n).select("id", permuted(F.col("id"), F.lit(n), seed).alias("p")).orderBy("id").collect()]
    one, other = at(0), at(5)
    assert sorted(one) == sorted(other) == list(range(n))
    if n > 200:
        assert one != other and sum(i == p for i, p in enumerate(one)) < 12
        ranks = np.corrcoef(np.arange(n), one)[0, 1], np.corrcoef(one[:-1], one[1:])[0, 1]
        assert max(map(abs, ranks)) < 4 / np.sqrt(n)


@pytest.mark.parametrize("wrap", [False, True])
def test_extremes_line_by_line(spark, wrap):
    """Sparse cells of two grids of different shapes over several tiles, missing values, against every window tried."""
    rng = np.random.default_rng(5)
    shapes, height, width = {"a": (70, 41), "b": (9, 100)}, 8, 6
    grids = {k: np.where(rng.random(s) < 0.1, rng.normal(size=s), np.nan) for k, s in shapes.items()}
    rows = [(k, int(r), int(c), float(g[r, c]), *shapes[k]) for k, g in grids.items() for r, c in np.argwhere(np.isfinite(g))] + [("a", 3, 3, float("nan"), 70, 41)] * bool(np.isnan(grids["a"][3, 3]))
    frame = spark.createDataFrame(rows, "k string, r int, c int, v double, h int, w int")
    out = windows2d.sliding_extremes(frame, "r", "c", "v", F.col("h"), F.col("w"), height, width, ["k"], wrap)
    got = {(x["k"], x["anchor_row"], x["anchor_col"]): (x["n"], x["min"], x["max"]) for x in out.collect() if x["n"]}
    want = {}
    for k, g in grids.items():
        around = np.concatenate([g, g[:, : width - 1]], axis=1) if wrap else g
        for r in range(g.shape[0] - height + 1):
            for c in range(around.shape[1] - width + 1):
                part = around[r : r + height, c : c + width]
                part = part[np.isfinite(part)]
                if len(part):
                    want[k, r, c] = (len(part), part.min(), part.max())
    assert got == want
    assert out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].count("Exchange") == 1
