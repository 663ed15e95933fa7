"""Queries over fine samples: masks, spectra, binning, variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from varigrid.functions.geo import METRES_PER_DEGREE
from varigrid.functions.nulls import masked, ratio
from varigrid.functions.text import first_token
from varigrid.operators import agreement, binning, ledger, spectral, variance
from varigrid.plans.registry import as_rrs, query, rounded
from varigrid.sources import cubes
from varigrid.sources.fixtures import COARSE, FINE, scratch

PX = ("fx_pixels",)
BANDS = {443.0: "b443", 490.0: "b490", 560.0: "b560", 665.0: "b665", 865.0: "b865"}
NAMED = {c: c for c in BANDS.values()}
RATIOS = {"blue_green": ("b490", "b560"), "green_blue": ("b560", "b490"), "red_green": ("b665", "b560"), "green_red": ("b560", "b665")}
#: The samples' bands as rows, in SQL.
LONG = "long AS (" + " UNION ALL ".join(f"SELECT r, c, '{c}' AS band, {nm} AS wavelength, {c} AS v FROM fx_pixels WHERE water" for nm, c in BANDS.items()) + ")"


def wet(t):
    return t("fx_pixels").where("water")


@query("SELECT y, x, round(avg((b560 - b865) / nullif(b560 + b865, 0)), 9) AS ndwi FROM fx_pixels GROUP BY y, x", PX)
def ndwi(t):
    return t("fx_pixels").groupBy("y", "x").agg(F.round(F.avg(spectral.ndwi(F.col("b560"), F.col("b865"))), 9).alias("ndwi"))


@query(
    """SELECT bin, round(-1 + (bin + 1) * 0.03125, 9) AS threshold FROM (SELECT bin, row_number() OVER (ORDER BY
 round(CAST(n0 AS DOUBLE) * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) * (s0 / n0 - (ss - s0) / (nn - n0)), 6) DESC, bin) AS k FROM run WHERE n0 < nn) WHERE k = 1""",
    PX,
    """hist AS (SELECT least(greatest(CAST(floor(((b560 - b865) / nullif(b560 + b865, 0) + 1) / 0.03125) AS BIGINT), 0), 63) AS bin, count(*) AS n FROM fx_pixels GROUP BY 1),
 run AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) AS n0, CAST(sum(n * bin) OVER (ORDER BY bin) AS DOUBLE) AS s0, CAST(sum(n) OVER () AS DOUBLE) AS nn, CAST(sum(n * bin) OVER () AS DOUBLE) AS ss FROM hist)""",
)
def otsu_threshold(t):
    px = t("fx_pixels").select(spectral.ndwi(F.col("b560"), F.col("b865")).alias("ndwi"))
    return spectral.otsu_threshold(px, "ndwi", -1.0, 1.0, 64).select("bin", *rounded(9, "threshold"))


@query(
    "SELECT DISTINCT y, x FROM (SELECT y + dy AS y, x + dx AS x FROM eroded, o)",
    PX,
    """cells AS (SELECT y, x FROM fx_pixels GROUP BY y, x HAVING bool_or(water)),
 o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx)),
 eroded AS (SELECT y - dy AS y, x - dx AS x FROM cells, o GROUP BY 1, 2 HAVING count(*) = 5)""",
)
def binary_opening(t):
    cells = t("fx_pixels").groupBy("y", "x").agg(F.bool_or("water").alias("water"))
    return spectral.binary_opening(cells, "y", "x", "water")


@query(
    "SELECT DISTINCT y + dy AS y, x + dx AS x FROM eroded, o",
    ["fx_coarse"],
    """cells AS (SELECT y, x FROM (SELECT r * 10 + a.i AS y, c * 10 + b.i AS x, r, c FROM fx_coarse, range(0, 10) a(i), range(0, 10) b(i)) WHERE (y * 7 + x * 11 + r * c) % 397 <> 0),
 o AS (SELECT a.i AS dy, b.i AS dx FROM range(0, 15) a(i), range(0, 15) b(i)),
 eroded AS (SELECT y - dy AS y, x - dx AS x FROM cells, o GROUP BY 1, 2 HAVING count(*) = 225)""",
)
def box_opening(t):
    """The coarse cells, ten fine cells wide and pricked, opened by a square of fifteen."""
    wide = t("fx_coarse").select("r", "c", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    cells = wide.select((F.col("r") * 10 + F.col("i")).alias("y"), (F.col("c") * 10 + F.col("j")).alias("x"), "r", "c")
    pricked = cells.withColumn("water", (F.col("y") * 7 + F.col("x") * 11 + F.col("r") * F.col("c")) % 397 != 0)
    return spectral.box_opening(pricked, "y", "x", "water", 15, 15)


@query("SELECT band, round(quantile_cont(v, 0.01) / pi(), 9) AS pedestal FROM long GROUP BY band", PX, LONG)
def dark_offset(t):
    return spectral.dark_offset(wet(t), NAMED).select("band", *as_rrs(9, "pedestal"))


@query(
    "SELECT r, c, round(avg((b560 - o) / pi()), 9) AS rrs FROM fx_pixels, (SELECT quantile_cont(b560, 0.01) AS o FROM fx_pixels WHERE water) WHERE water GROUP BY r, c",
    PX,
)
def to_rrs(t):
    px = wet(t)
    some = {"b560": "b560"}
    return spectral.to_rrs(px, spectral.dark_offset(px, some), some).groupBy("r", "c").agg(F.round(F.avg("rrs_b560"), 9).alias("rrs"))


@query("SELECT r, c, round(avg(b560 / nullif(b490, 0)), 9) AS mean_ratio, CAST(count(*) AS BIGINT) AS n FROM fx_pixels WHERE water GROUP BY r, c", PX)
def band_ratio(t):
    q = ratio(F.col("b560"), F.col("b490"))
    return wet(t).groupBy("r", "c").agg(F.round(F.avg(q), 9).alias("mean_ratio"), F.count(q).alias("n"))


#: Band lists of five scenes and the wanted wavelengths, in SQL.
LISTS = """bands AS (SELECT n_regionkey AS scene, n_nationkey AS band_index, CAST(400 + ((n_nationkey * 7) % 25) * 20 AS DOUBLE) AS wavelength_nm FROM nation),
 targets AS (SELECT CAST(410 + r_regionkey * 97 AS DOUBLE) AS nm FROM region)"""


def lists(t):
    bands = t("nation").select(F.col("n_regionkey").alias("scene"), F.col("n_nationkey").alias("band_index"), (400 + F.pmod(F.col("n_nationkey") * 7, F.lit(25)) * 20).cast("double").alias("wavelength_nm"))
    return bands, t("region").select((410 + F.col("r_regionkey") * 97).cast("double").alias("nm"))


@query(
    "SELECT scene, nm, band_index, wavelength_nm FROM (SELECT *, row_number() OVER (PARTITION BY scene, nm ORDER BY abs(wavelength_nm - nm), band_index) AS k FROM bands, targets) WHERE k = 1",
    (),
    LISTS,
)
def nearest_band(t):
    return agreement.nearest_band(*lists(t), keys=["scene"])


@query(
    "SELECT scene, nm, band_index, wavelength_nm FROM (SELECT *, row_number() OVER (PARTITION BY scene, nm ORDER BY band_index) AS k FROM bands, targets WHERE abs(wavelength_nm - nm) <= 30) WHERE k = 1",
    (),
    LISTS,
)
def band_match(t):
    return agreement.band_match(*lists(t), within=30.0, keys=["scene"])


@query(
    "SELECT scene, CAST(count(*) AS BIGINT) AS n_bands, coalesce(bool_and(wavelength_nm > before), true) AS increasing FROM (SELECT *, lag(wavelength_nm) OVER (PARTITION BY scene ORDER BY band_index) AS before FROM bands) GROUP BY scene",
    (),
    LISTS,
)
def band_monotonic(t):
    return ledger.band_monotonic(lists(t)[0], ["scene"])


MOMENTS = "m AS (SELECT r, c, count(q) AS n, avg(q) AS mean, stddev_pop(q) AS std FROM (SELECT r, c, b443 / nullif(b490, 0) AS q FROM fx_pixels WHERE water) GROUP BY r, c)"


def blue(t):
    return binning.bin_moments(wet(t).withColumn("q", ratio(F.col("b443"), F.col("b490"))), ["r", "c"], "q")


@query("SELECT r, c, CAST(n AS BIGINT) AS n, round(mean, 9) AS mean, round(std, 9) AS std FROM m", PX, MOMENTS)
def bin_moments(t):
    return blue(t).select("r", "c", "n", *rounded(9, "mean", "std"))


@query("SELECT r, c, round(std / nullif(abs(mean), 0), 9) AS cv FROM m", PX, MOMENTS)
def within_cv(t):
    return blue(t).select("r", "c", F.round(binning.within_cv(F.col("mean"), F.col("std")), 9).alias("cv"))


@query("SELECT r, c, round(mean, 9) AS mean, round(CASE WHEN mean BETWEEN 0.6 AND 0.63 THEN std / nullif(abs(mean), 0) END, 9) AS cv FROM m", PX, MOMENTS)
def mask_range(t):
    cv = masked(binning.within_cv(F.col("mean"), F.col("std")), F.col("mean"), 0.60, 0.63)
    return blue(t).select("r", "c", F.round("mean", 9).alias("mean"), F.round(cv, 9).alias("cv"))


FRACTION = "SELECT r, c, CAST(count(*) FILTER (WHERE water) AS BIGINT) AS n_water, CAST(count(*) AS BIGINT) AS n_valid, round(CAST(count(*) FILTER (WHERE water) AS DOUBLE) / count(*), 9) AS frac_water FROM fx_pixels GROUP BY r, c"


@query(FRACTION, PX)
def water_fraction(t):
    return binning.water_fraction(t("fx_pixels"), ["r", "c"]).select("r", "c", "n_water", "n_valid", *rounded(9, "frac_water"))


@query("SELECT r, c, CAST(wavelength AS DOUBLE) AS band, CAST(count(v) AS BIGINT) AS n, round(avg(v) / pi(), 9) AS mean, round(stddev_pop(v) / pi(), 9) AS std FROM long WHERE wavelength BETWEEN 400 AND 700 GROUP BY r, c, wavelength", PX, LONG)
def band_moments(t):
    return binning.band_moments(wet(t), ["r", "c"], BANDS, 400, 700).select("r", "c", "band", "n", *as_rrs(9, "mean", "std"))


FRAME = (
    "frame AS (SELECT r, c, count(*) FILTER (WHERE water) AS n_water, count(*) AS n_valid, CAST(count(*) FILTER (WHERE water) AS DOUBLE) / count(*) AS frac_water, "
    + ", ".join(f"avg({c}) FILTER (WHERE water) AS rrs_mean_{nm:.0f}, stddev_pop({c}) FILTER (WHERE water) AS rrs_std_{nm:.0f}" for nm, c in BANDS.items())
    + ", "
    + ", ".join(f"avg({a} / nullif({b}, 0)) FILTER (WHERE water) AS {n}_mean, stddev_pop({a} / nullif({b}, 0)) FILTER (WHERE water) AS {n}_std, count({a} / nullif({b}, 0)) FILTER (WHERE water) AS {n}_n" for n, (a, b) in RATIOS.items())
    + " FROM fx_pixels GROUP BY r, c HAVING count(*) FILTER (WHERE water) > 0)"
)
BAND_COLUMNS = [f"rrs_{s}_{nm:.0f}" for nm in BANDS for s in ("mean", "std")]
RATIO_COLUMNS = [f"{n}_{s}" for n in RATIOS for s in ("mean", "std", "cv")]


def frame(t):
    return binning.aggregate_scene(t("fx_pixels"), ["r", "c"], BANDS, RATIOS)


@query(
    "SELECT r, c, CAST(n_water AS BIGINT) AS n_water, CAST(n_valid AS BIGINT) AS n_valid, round(frac_water, 9) AS frac_water, "
    + ", ".join(f"round({c} / pi(), 9) AS {c}" for c in BAND_COLUMNS)
    + ", "
    + ", ".join(f"round({n}_mean, 9) AS {n}_mean, round({n}_std, 9) AS {n}_std, round({n}_std / nullif(abs({n}_mean), 0), 9) AS {n}_cv, CAST({n}_n AS BIGINT) AS {n}_n" for n in RATIOS)
    + " FROM frame",
    PX,
    FRAME,
)
def aggregate_scene(t):
    return frame(t).select("r", "c", "n_water", "n_valid", *as_rrs(9, *BAND_COLUMNS), *rounded(9, "frac_water", *RATIO_COLUMNS), *(f"{n}_n" for n in RATIOS))


@query(
    "SELECT CAST(count(*) AS BIGINT) AS n_coarse_with_water, CAST(count(*) FILTER (WHERE frac_water >= 0.9) AS BIGINT) AS n_coarse_usable, CAST(sum(n_water) AS BIGINT) AS px_assigned, CAST(coalesce(median(n_water) FILTER (WHERE frac_water >= 0.9), 0) AS DOUBLE) AS median_px_per_coarse FROM frame",
    PX,
    FRAME,
)
def scene_ledger(t):
    return binning.scene_ledger(frame(t))


@query("SELECT band, CAST(count(v) AS BIGINT) AS n, round(median(v) / pi(), 9) AS median, round(quantile_cont(v, 0.01) / pi(), 9) AS p1 FROM long GROUP BY band", PX, LONG)
def water_spectrum(t):
    return spectral.water_spectrum(wet(t), NAMED).select("band", "n", *as_rrs(9, "median", "p1"))


@query(
    """SELECT CAST(count(*) FILTER (WHERE water) AS BIGINT) AS n_water, CAST(count(*) AS BIGINT) AS n_valid, round(CAST(count(*) FILTER (WHERE water) AS DOUBLE) / count(*), 9) AS water_share,
 round(median(b560) FILTER (WHERE water) / median(b865) FILTER (WHERE water), 9) AS green_over_nir, round(median(b665) FILTER (WHERE water) / median(b560) FILTER (WHERE water), 9) AS relative_uncertainty FROM fx_pixels""",
    PX,
)
def water_check(t):
    return spectral.water_check(t("fx_pixels"), "water", "b560", "b865", "b665").select("n_water", "n_valid", *rounded(9, "water_share", "green_over_nir", "relative_uncertainty"))


def _split(value: str) -> str:
    parts = []
    for f in (4, 18, 40):
        n = FINE // f * f
        parts.append(
            f"""SELECT {f} AS factor, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - g) * (m - g)) / sum(n) AS between, sum(n * s2) / sum(n) AS within FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM
 (SELECT count(v) AS n, avg(v) AS m, var_pop(v) AS s2 FROM (SELECT y, x, {value} AS v FROM fx_pixels WHERE water AND y < {n} AND x < {n}) GROUP BY floor(y / {f}.0), floor(x / {f}.0) HAVING count(v) > 0))"""
        )
    return " UNION ALL ".join(parts)


@query("SELECT factor, n, round(between, 9) AS between, round(within, 9) AS within, round(between + within, 9) AS total FROM (" + _split("b443 / nullif(b490, 0)") + ")", PX)
def variance_split(t):
    px = wet(t).withColumn("v", ratio(F.col("b443"), F.col("b490")))
    return variance.variance_split(px, "y", "x", "v", [4, 18, 40], FINE, FINE).select("factor", "n", *rounded(9, "between", "within", "total"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS scalar, factor, n_finite, round(total_variance, 9) AS total_variance, round(between / (between + within), 9) AS between_cell_fraction, round(1 - between / (between + within), 9) AS within_cell_fraction
 FROM ({_split(v)}), (SELECT CAST(count({v}) AS BIGINT) AS n_finite, var_pop({v}) AS total_variance FROM fx_pixels WHERE water) WHERE n_finite >= 480 AND total_variance > 0"""
        for name, v in (("ratio", "b443 / nullif(b490, 0)"), ("band", "b560"))
    ),
    PX,
)
def variance_ladder(t):
    px = wet(t).withColumn("v", ratio(F.col("b443"), F.col("b490")))
    out = variance.variance_ladder(px, "y", "x", {"ratio": "v", "band": "b560"}, [4, 18, 40], FINE, FINE)
    return out.select("scalar", "factor", "n_finite", *rounded(9, "total_variance", "between_cell_fraction", "within_cell_fraction"))


@query("SELECT CAST(floor(y / 18.0) AS BIGINT) AS block_row, CAST(floor(x / 18.0) AS BIGINT) AS block_col, CAST(count(b560) AS BIGINT) AS n, round(avg(b560) / pi(), 9) AS mean FROM fx_pixels WHERE water AND y < 90 AND x < 90 GROUP BY 1, 2", PX)
def block_mean(t):
    return variance.block_mean(wet(t), "y", "x", "b560", 18, FINE, FINE).select("block_row", "block_col", "n", *as_rrs(9, "mean"))


@query("SELECT round(quantile_cont(b560 / nullif(b490, 0), 0.08), 9) AS low, round(quantile_cont(b560 / nullif(b490, 0), 0.92), 9) AS high FROM fx_pixels WHERE water", PX)
def stretch_pct(t):
    return variance.stretch(wet(t).withColumn("v", ratio(F.col("b560"), F.col("b490"))), "v").select(*rounded(9, "low", "high"))


@query(
    "SELECT greatest(CAST(floor((SELECT median(y) FROM (SELECT DISTINCT y FROM fx_pixels WHERE water))) AS BIGINT) - 20, 0) AS row0, greatest(CAST(floor((SELECT median(x) FROM (SELECT DISTINCT x FROM fx_pixels WHERE water))) AS BIGINT) - 20, 0) AS col0",
    PX,
)
def centre_window(t):
    return variance.centre_window(wet(t), "y", "x", 40)


@query(
    f"""SELECT scene_id, round(w, 6) AS west_px, round(s, 6) AS south_px, round(e, 6) AS east_px, round(n, 6) AS north_px, round(greatest(-least(w, s, e, n), 0), 6) + 0.0 AS worst_shortfall_px, round(greatest(w, s, e, n), 6) AS widest_margin_px, least(w, s, e, n) > -1 AS contains
 FROM (SELECT scene_id, (west - gw) * {METRES_PER_DEGREE} / 30 * cos(radians(mid)) AS w, (south - gs) * {METRES_PER_DEGREE} / 30 AS s, (ge - east) * {METRES_PER_DEGREE} / 30 * cos(radians(mid)) AS e, (gn - north) * {METRES_PER_DEGREE} / 30 AS n FROM g)""",
    ("fx_scenes",),
    """g AS (SELECT scene_id, lon - 0.15 AS west, lat - 0.1 AS south, lon + 0.15 AS east, lat + 0.1 AS north, lon - 0.1503 AS gw, lon + 0.1507 AS ge, lat - 0.1001 AS gs, lat + 0.0995 AS gn, (lat - 0.1001 + lat - 0.1001 + lat + 0.0995 + lat + 0.0995) / 4 AS mid FROM fx_scenes)""",
)
def bbox_margin(t):
    s = t("fx_scenes")
    boxes = s.select("scene_id", *((F.col(c) + d).alias(n) for n, c, d in (("west", "lon", -0.15), ("south", "lat", -0.1), ("east", "lon", 0.15), ("north", "lat", 0.1))))
    corner = F.explode(F.array(*(F.struct((F.col("lon") + a).alias("lon"), (F.col("lat") + b).alias("lat")) for a in (-0.1503, 0.1507) for b in (-0.1001, 0.0995)))).alias("p")
    corners = s.select("scene_id", corner).select("scene_id", "p.*")
    out = spectral.bbox_margin(corners, boxes, ["scene_id"])
    return out.select("scene_id", *rounded(6, "west_px", "south_px", "east_px", "north_px", "worst_shortfall_px", "widest_margin_px"), "contains")


#: The fine means beside the coarse retrievals, in SQL; the retrieval stands for the coarse sensor's band.
PAIRED = "paired AS (SELECT f.*, k.coarse_index, k.coarse_rrs560, k.coarse_rrs490 FROM frame f JOIN fx_coarse k USING (r, c) WHERE frac_water >= 0.5)"
AGREE = f"""{FRAME}, {PAIRED},
 pairs AS (SELECT 490.0 AS wavelength_nm, rrs_mean_490 AS t, coarse_rrs490 AS k FROM paired UNION ALL SELECT 560.0, rrs_mean_560, coarse_rrs560 FROM paired),
 stats AS (SELECT CAST(wavelength_nm AS DOUBLE) AS wavelength_nm, count(*) AS n, corr(t, k) AS correlation, regr_slope(t, k) AS slope, median(t) AS fine_median, median(k) AS coarse_median FROM pairs WHERE t IS NOT NULL AND k IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)"""
BOTH = ("fx_pixels", "fx_coarse")


def paired(t):
    return frame(t).join(t("fx_coarse"), ["r", "c"]).where("frac_water >= 0.5")


def agreed(t):
    return agreement.spectral_agreement(paired(t), {490.0: "rrs_mean_490", 560.0: "rrs_mean_560"}, {490.0: "coarse_rrs490", 560.0: "coarse_rrs560"})


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(corr(rrs_mean_560, coarse_rrs560), 7) AS correlation FROM paired HAVING count(*) >= 20", BOTH, f"{FRAME}, {PAIRED}")
def pair_corr(t):
    return agreement.pair_stats(paired(t), "rrs_mean_560", "coarse_rrs560").select("n", *rounded(7, "correlation"))


@query("SELECT r % 3 AS third, CAST(count(*) AS BIGINT) AS n, round(regr_slope(rrs_mean_560, coarse_rrs560), 7) AS slope FROM paired GROUP BY 1 HAVING count(*) >= 20", BOTH, f"{FRAME}, {PAIRED}")
def pair_slope(t):
    return agreement.pair_stats(paired(t).withColumn("third", F.col("r") % 3), "rrs_mean_560", "coarse_rrs560", ["third"]).select("third", "n", *rounded(7, "slope"))


@query("SELECT wavelength_nm, CAST(n AS BIGINT) AS n, round(correlation, 7) AS correlation, round(fine_median / pi(), 9) AS fine_median, round(coarse_median / pi(), 9) AS coarse_median, round(fine_median / nullif(coarse_median, 0), 9) AS ratio_of_medians FROM stats", BOTH, AGREE)
def spectral_agreement(t):
    return agreed(t).select("wavelength_nm", "n", *rounded(7, "correlation"), *as_rrs(9, "fine_median", "coarse_median"), *rounded(9, "ratio_of_medians"))


WORST = "(SELECT round(min(correlation), 7) AS worst_correlation, (SELECT round(slope, 7) FROM stats WHERE slope > 0 ORDER BY abs(ln(slope)) DESC, slope DESC LIMIT 1) AS worst_spread FROM stats)"


@query(f"SELECT * FROM {WORST}", BOTH, AGREE)
def worst_spread(t):
    return agreement.worst_spread(agreed(t)).select(*rounded(7, "worst_correlation", "worst_spread"))


@query(f"SELECT *, coalesce(worst_correlation >= 0.6 AND abs(ln(worst_spread)) <= ln(2.5), false) AS passes FROM {WORST}", BOTH, AGREE)
def agreement_gate(t):
    return agreement.agreement_gate(agreed(t)).select(*rounded(7, "worst_correlation", "worst_spread"), "passes")


NEAREST = """centres AS (SELECT coarse_index, c * 4 + 1.5 AS cx, r * 4 + 1.5 AS cy FROM fx_coarse),
 points AS (SELECT o_orderkey AS point, CAST((o_orderkey * 7) % 96 AS DOUBLE) AS x, CAST((o_custkey * 5) % 96 AS DOUBLE) AS y FROM orders)"""


@query(
    """SELECT point, coarse_index, round(sqrt(d2), 9) AS distance FROM (SELECT point, coarse_index, d2, row_number() OVER (PARTITION BY point, x, y ORDER BY d2, coarse_index) AS k FROM
 (SELECT point, x, y, coarse_index, CAST((x - cx) * (x - cx) + (y - cy) * (y - cy) AS DOUBLE) AS d2 FROM points, centres)) WHERE k = 1 AND sqrt(d2) <= 4""",
    BOTH,
    NEAREST,
)
def nearest_join(t):
    centres = t("fx_coarse").select("coarse_index", (F.col("c") * 4 + 1.5).cast("double").alias("cx"), (F.col("r") * 4 + 1.5).cast("double").alias("cy"))
    points = t("orders").select(F.col("o_orderkey").alias("point"), F.pmod(F.col("o_orderkey") * 7, F.lit(96)).cast("double").alias("x"), F.pmod(F.col("o_custkey") * 5, F.lit(96)).cast("double").alias("y"))
    return binning.nearest_join(points, centres, 4.0).select("point", "coarse_index", *rounded(9, "distance"))


@query(
    "SELECT round(median(d), 9) AS spacing, CAST(0 AS BIGINT) AS n_alone FROM (SELECT a.coarse_index, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a, p b WHERE a.coarse_index <> b.coarse_index GROUP BY 1)",
    BOTH,
    "p AS (SELECT coarse_index, CAST(c * 4 AS DOUBLE) + CAST((r * 7 + c * 13) % 5 AS DOUBLE) / 8 AS x, CAST(r * 4 AS DOUBLE) + CAST((r * 3 + c) % 3 AS DOUBLE) / 8 AS y FROM fx_coarse)",
)
def median_spacing(t):
    r, c = F.col("r"), F.col("c")
    p = t("fx_coarse").select((c * 4).cast("double").alias("cx") + F.pmod(r * 7 + c * 13, F.lit(5)).cast("double") / 8, (r * 4).cast("double") + F.pmod(r * 3 + c, F.lit(3)).cast("double") / 8).toDF("x", "y")
    return binning.median_spacing(p, reach=16.0).select(*rounded(9, "spacing"), "n_alone")


@query("SELECT coarse_index, CAST(floor(coarse_index / 24.0) AS BIGINT) AS cell_row, coarse_index % 24 AS cell_col FROM fx_coarse", BOTH)
def unravel_index(t):
    from varigrid.functions.grids import unravel

    row, col = unravel(F.col("coarse_index"), COARSE)
    return t("fx_coarse").select("coarse_index", row.alias("cell_row"), col.alias("cell_col"))


@query("SELECT a.coarse_index, round(a.coarse_rrs560 / pi(), 9) AS coarse_rrs560, round(b.coarse_rrs490 / pi(), 9) AS coarse_rrs490 FROM fx_coarse a LEFT JOIN (SELECT * FROM fx_coarse WHERE c % 2 = 0) b USING (coarse_index)", BOTH)
def merge_first_wins(t):
    k = t("fx_coarse")
    right = k.where("c % 2 = 0").select("coarse_index", (F.col("coarse_rrs560") * 2).alias("coarse_rrs560"), "coarse_rrs490")
    return ledger.merge_first_wins(k.select("coarse_index", "coarse_rrs560"), right, ["coarse_index"]).select("coarse_index", *as_rrs(9, "coarse_rrs560", "coarse_rrs490"))


#: Two scenes of the fine samples (even and odd rows) and the cells of two sensors with their own spacings, in SQL.
SCENES = """px AS (SELECT CASE WHEN y % 2 = 0 THEN 'even' ELSE 'odd' END AS scene, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, water, b490, b560 FROM fx_pixels),
 grid AS (SELECT scene, sensor, w, r * (96 // w) + c AS coarse_index, c * w + (w - 1) / 2.0 AS cx, r * w + (w - 1) / 2.0 AS cy, (r * 3 + c * 5 + w + length(scene)) / 100.0 AS RRS560
  FROM (VALUES ('even'), ('odd')) a(scene), (VALUES ('olci', 4), ('pace', 8)) b(sensor, w), range(0, 24) p(r), range(0, 24) q(c) WHERE r < 96 // w AND c < 96 // w),
 spots AS (SELECT DISTINCT scene, x, y FROM px),
 near AS (SELECT * FROM (SELECT scene, sensor, x, y, coarse_index, d2, w, row_number() OVER (PARTITION BY scene, sensor, x, y ORDER BY d2, coarse_index) AS k FROM (SELECT s.scene, sensor, x, y, coarse_index, w, pow(x - cx, 2) + pow(y - cy, 2) AS d2 FROM spots s JOIN grid g ON s.scene = g.scene AND abs(x - cx) <= w AND abs(y - cy) <= w)) WHERE k = 1 AND sqrt(d2) <= w),
 dark AS (SELECT scene, quantile_cont(b560, 0.01) AS o560, quantile_cont(b490, 0.01) AS o490 FROM px WHERE water GROUP BY scene)"""


def scenes_and_grids(t):
    px = t("fx_pixels").select(F.when(F.col("y") % 2 == 0, "even").otherwise("odd").alias("scene"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "water", "b490", "b560")
    spark = px.sparkSession
    side = lambda w: [(s, n, r * (96 // w) + c, c * w + (w - 1) / 2, r * w + (w - 1) / 2, (r * 3 + c * 5 + w + len(s)) / 100) for s in ("even", "odd") for n in (["olci"] if w == 4 else ["pace"]) for r in range(96 // w) for c in range(96 // w)]
    return px, spark.createDataFrame(side(4) + side(8), "scene string, sensor string, coarse_index long, cx double, cy double, RRS560 double")


@query(
    """SELECT scene, sensor, coarse_index, CAST(count(*) FILTER (WHERE water) AS BIGINT) AS n_water, CAST(count(*) AS BIGINT) AS n_valid, round(avg((b560 - o560) / pi()) FILTER (WHERE water), 9) AS rrs_mean_560, round(stddev_pop((b560 - o560) / pi()) FILTER (WHERE water), 9) AS rrs_std_560,
 CAST(count((b560 - o560) / nullif(b490 - o490, 0)) FILTER (WHERE water) AS BIGINT) AS green_blue_n, max(RRS560) AS coarse_RRS560 FROM px JOIN near USING (scene, x, y) JOIN dark USING (scene) JOIN grid USING (scene, sensor, coarse_index) GROUP BY scene, sensor, coarse_index HAVING count(*) FILTER (WHERE water) > 0""",
    PX,
    SCENES,
)
def aggregate_stage(t):
    """The aggregate frame of two scenes and two sensors at once, each granule with its own spacing."""
    from varigrid.plans import stages

    out = stages.aggregate_stage(*scenes_and_grids(t), {490.0: "b490", 560.0: "b560"}, ratios=[("green_blue", 560.0, 490.0)])
    return out.select("scene", "sensor", "coarse_index", "n_water", "n_valid", *rounded(9, "rrs_mean_560", "rrs_std_560"), "green_blue_n", "coarse_RRS560")


@query(
    "SELECT granule, round(median(d), 6) AS spacing FROM (SELECT a.granule, a.coarse_index, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.granule = b.granule AND a.coarse_index <> b.coarse_index GROUP BY 1, 2) GROUP BY 1",
    BOTH,
    "p AS (SELECT r_name AS granule, coarse_index, (CAST(c * 4 AS DOUBLE) + CAST((r * 7 + c * 13) % 5 AS DOUBLE) / 8) * pow(10, r_regionkey) / 4 AS x, (CAST(r * 4 AS DOUBLE) + CAST((r * 3 + c) % 3 AS DOUBLE) / 8) * pow(10, r_regionkey) / 4 AS y FROM fx_coarse, region)",
)
def granule_spacing(t):
    """The coarse cells as granules of every region, each ten times as wide as the one before."""
    r, c, wide = F.col("r"), F.col("c"), F.pow(F.lit(10), "r_regionkey") / 4
    x = ((c * 4).cast("double") + F.pmod(r * 7 + c * 13, F.lit(5)).cast("double") / 8) * wide
    y = ((r * 4).cast("double") + F.pmod(r * 3 + c, F.lit(3)).cast("double") / 8) * wide
    p = t("fx_coarse").join(F.broadcast(t("region")), F.lit(True)).select(F.col("r_name").alias("granule"), x.alias("x"), y.alias("y"))  # five regions
    return binning.granule_spacing(p, ["granule"]).select("granule", *rounded(6, "spacing"))


@query("SELECT f.r, f.c, CAST(n_water AS BIGINT) AS n_water, round(coarse_rrs560 / pi(), 9) AS coarse_RRS560 FROM frame f LEFT JOIN fx_coarse k ON f.r = k.r AND f.c = k.c", BOTH, FRAME)
def attach_coarse(t):
    from varigrid.sources import tables

    k = t("fx_coarse").select("r", "c", F.col("coarse_rrs560").alias("RRS560"), F.col("coarse_rrs490").alias("other"))
    return tables.attach_coarse(frame(t), k, "c", keys=["r"]).select("r", "c", "n_water", *as_rrs(9, "coarse_RRS560"))


MASK = """cells AS (SELECT y, x, avg(b560) AS g, avg(b865) AS n, max(CASE WHEN water THEN 0 ELSE 1 END) AS flag FROM fx_pixels GROUP BY y, x),
 idx AS (SELECT *, CASE WHEN flag = 0 THEN (g - n) / nullif(g + n, 0) END AS v FROM cells),
 hist AS (SELECT least(greatest(CAST(floor((v + 1) / 0.03125) AS BIGINT), 0), 63) AS bin, count(*) AS k FROM idx WHERE v IS NOT NULL GROUP BY 1),
 run AS (SELECT bin, CAST(sum(k) OVER (ORDER BY bin) AS DOUBLE) AS n0, CAST(sum(k * bin) OVER (ORDER BY bin) AS DOUBLE) AS s0, CAST(sum(k) OVER () AS DOUBLE) AS nn, CAST(sum(k * bin) OVER () AS DOUBLE) AS ss FROM hist),
 edge AS (SELECT -1 + (bin + 1) * 0.03125 AS t FROM run WHERE n0 < nn ORDER BY round(CAST(n0 AS DOUBLE) * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) * (s0 / n0 - (ss - s0) / (nn - n0)), 6) DESC, bin LIMIT 1),
 wet AS (SELECT y, x FROM idx, edge WHERE v >= t),
 o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx)),
 eroded AS (SELECT y - dy AS y, x - dx AS x FROM wet, o GROUP BY 1, 2 HAVING count(*) = 5),
 opened AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM eroded, o)"""


@query("SELECT c.y, c.x, o.y IS NOT NULL AS water FROM cells c LEFT JOIN opened o ON o.y = c.y AND o.x = c.x", PX, MASK)
def water_mask(t):
    cells = t("fx_pixels").groupBy("y", "x").agg(F.avg("b560").alias("g"), F.avg("b865").alias("n"), F.max((~F.col("water")).cast("int")).alias("flag"))
    return spectral.water_mask(cells, "y", "x", "g", "n", flags=["flag"]).select("y", "x", "water")


@query(
    """SELECT y - row0 AS row, x - col0 AS col, CAST(count(*) AS BIGINT) AS n, round(avg((b560 - o560) / pi()), 9) AS band, round(avg(CASE WHEN (b560 - o560) / nullif(b490 - o490, 0) BETWEEN 0.2 AND 5 THEN (b560 - o560) / nullif(b490 - o490, 0) END), 7) AS ratio
 FROM fx_pixels, (SELECT quantile_cont(b560, 0.01) AS o560, quantile_cont(b490, 0.01) AS o490 FROM fx_pixels WHERE water),
 (SELECT greatest(CAST(floor((SELECT median(y) FROM (SELECT DISTINCT y FROM fx_pixels WHERE water))) AS BIGINT) - 20, 0) AS row0, greatest(CAST(floor((SELECT median(x) FROM (SELECT DISTINCT x FROM fx_pixels WHERE water))) AS BIGINT) - 20, 0) AS col0)
 WHERE water AND y - row0 BETWEEN 0 AND 39 AND x - col0 BETWEEN 0 AND 39 GROUP BY 1, 2""",
    PX,
)
def ladder_patch(t):
    from varigrid.plans import stages

    px = t("fx_pixels").withColumnsRenamed({"y": "row", "x": "col"}).withColumn("scene", F.lit("s"))
    out = stages.ladder_patch(px, {490.0: "b490", 560.0: "b560"}, patch=40)
    return out.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("band"), 9).alias("band"), F.round(F.avg("ratio"), 7).alias("ratio"))


@query(
    f"""SELECT 'G0' AS tag, CASE WHEN bool_and(n >= 500) AND count(*) = 24 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT r, count(*) AS n FROM fx_pixels WHERE water GROUP BY r)
 UNION ALL SELECT 'V0', CASE WHEN CAST(count(*) FILTER (WHERE water) AS DOUBLE) / count(*) >= 0.15 AND median(b560) FILTER (WHERE water) / median(b865) FILTER (WHERE water) >= 1.05 THEN 'PASS' ELSE 'FAIL' END FROM fx_pixels
 UNION ALL SELECT 'V2', CASE WHEN worst_correlation IS NULL OR worst_spread IS NULL THEN 'NOT ASSESSABLE' WHEN worst_correlation >= 0.6 AND abs(ln(worst_spread)) <= ln(2.5) THEN 'PASS' ELSE 'FAIL' END FROM {WORST}
 UNION ALL SELECT 'V6', CASE WHEN max(n) > 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT count(*) AS n FROM fx_coarse)""",
    BOTH,
    AGREE,
)
def gate_verdicts(t):
    """Verdicts of the gates that read tables, by tag."""
    px = t("fx_pixels")
    files = px.where("water").groupBy(F.col("r").cast("string").alias("scene")).agg(F.count(F.lit(1)).alias("n_valid")).withColumn("opens", F.lit(True))
    rows = [ledger.fetch_gate(files, [str(r) for r in range(COARSE)]), ledger.water_gate(spectral.water_check(px, "water", "b560", "b865", "b665")), ledger.agreement_verdict(agreement.agreement_gate(agreed(t))), ledger.coverage_verdict(t("fx_coarse").count(), 1)]
    frame = px.sparkSession.createDataFrame([(r["hypothesis"], r["verdict"]) for r in rows], "hypothesis string, verdict string")
    return frame.select(first_token(F.col("hypothesis")).alias("tag"), "verdict")


@query(
    "SELECT y AS row, x AS col, round(CAST(max(CAST(b560 AS REAL)) AS DOUBLE), 9) AS green, round(CAST(max(CAST(b865 AS REAL)) AS DOUBLE), 9) AS nir FROM fx_pixels WHERE y >= 20 AND y < 60 AND (x + 0.5) * 30 < 2000 GROUP BY y, x",
    PX,
)
def cube_scan(t):
    """A cube of strips is written, and a window of two of its bands read: rows and columns by comparisons pushed to the scan."""
    px = t("fx_pixels").groupBy(F.col("y").alias("row"), F.col("x").alias("col")).agg(F.max("b560").alias("b560"), F.max("b665").alias("b665"), F.max("b865").alias("b865"))
    spark = px.sparkSession
    cubes.register(spark)
    path = f"{scratch(spark)}/cube"
    cubes.write_cube(px, path, ["b560", "b665", "b865"], FINE, FINE, rows=16)
    cube = spark.read.format("npycube").schema("row int, col int, x double, b0 float, b2 float").option("path", path).load()
    window = cube.where("row >= 20 and row < 60 and x < 2000").where("b0 is not null")
    return window.select(F.col("row").cast("long"), F.col("col").cast("long"), *(F.round(F.col(b).cast("double"), 9).alias(n) for b, n in (("b0", "green"), ("b2", "nir"))))


@query(
    """SELECT granule, line, pixel, line * 24 + pixel AS coarse_index, round(lat, 6) AS lat, round(lon, 6) AS lon, round(v / pi(), 9) AS Rrs_560 FROM
 (SELECT 'g' || (c % 3) AS granule, CAST(r AS INT) AS line, CAST(c AS INT) AS pixel, 41.5 - CAST(r AS DOUBLE) / 8 + CAST(c AS DOUBLE) / 100 AS lat, CAST(c AS DOUBLE) / 8 - 83 AS lon, coarse_rrs560 AS v FROM fx_coarse)
 WHERE granule IN ('g0', 'g2') AND lat BETWEEN 39.52 AND 40.97""",
    BOTH,
)
def swath_scan(t):
    """Swaths are written as groups of arrays and read within bounds of latitude, from two of three granules."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    cells = t("fx_coarse").select(F.concat(F.lit("g"), (F.col("c") % 3).cast("string")).alias("granule"), F.col("r").cast("int").alias("line"), F.col("c").cast("int").alias("pixel"), (41.5 - r / 8 + c / 100).alias("lat"), (c / 8 - 83).alias("lon"), F.col("coarse_rrs560").alias("Rrs_560"))
    spark = cells.sparkSession
    cubes.register(spark)
    paths = cubes.write_swath(cells, f"{scratch(spark)}/swaths", ["Rrs_560"], COARSE, COARSE)
    swaths = spark.read.format("npyswath").option("path", ",".join(paths)).load()
    some = swaths.where(F.col("granule").isin("g0", "g2") & F.col("lat").between(39.52, 40.97))
    return some.select("granule", "line", "pixel", "coarse_index", *rounded(6, "lat", "lon"), *as_rrs(9, "Rrs_560"))
