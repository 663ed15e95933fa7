"""Queries over sliding windows of the coarse field."""

from __future__ import annotations

from pyspark.sql import functions as F

from varigrid.config import BoxConfig
from varigrid.functions.geo import METRES_PER_DEGREE
from varigrid.functions.permutations import permuted_sql
from varigrid.operators import ledger, spectral, windows2d
from varigrid.plans import stages
from varigrid.plans.pixel_queries import BOTH, FRAME, frame
from varigrid.plans.registry import as_rrs, query, rounded
from varigrid.sources.fixtures import COARSE

N = COARSE
#: The fixtures' ratio lies in a narrower range than real water, so the mask is narrower too.
CONFIG = BoxConfig(mean_low=0.5, mean_high=0.98)

ANCHORS = f"o AS (SELECT a.i AS dr, b.i AS dc FROM range(0, 5) a(i), range(0, 5) b(i)), w AS (SELECT r - dr AS anchor_row, c - dc AS anchor_col, dr, dc, f.* FROM cells f, o WHERE r - dr BETWEEN 0 AND {N - 5} AND c - dc BETWEEN 0 AND {N - 5})"
COARSE_CELLS = "cells AS (SELECT r, c, coarse_rrs560 AS f FROM fx_coarse)"


def trimmed(value: str, name: str) -> str:
    """CTE ``name`` (anchor_row, anchor_col, fraction, cv) of a column of ``w``, with one pass of the rejection."""
    return f"""{name}_0 AS (SELECT anchor_row, anchor_col, count({value}) AS n, avg({value}) AS m, CASE WHEN min({value}) = max({value}) THEN 0 ELSE stddev_pop({value}) END AS s FROM w GROUP BY ALL),
 {name} AS (SELECT anchor_row, anchor_col, CAST(any_value(n) AS DOUBLE) / 25 AS fraction, CASE WHEN any_value(n) >= 12.5 THEN stddev_pop({value}) FILTER (WHERE abs({value} - m) <= 1.5 * s OR s = 0) / nullif(abs(avg({value}) FILTER (WHERE abs({value} - m) <= 1.5 * s OR s = 0)), 0) END AS cv
 FROM w JOIN {name}_0 USING (anchor_row, anchor_col) GROUP BY ALL)"""


@query("SELECT anchor_row, anchor_col, CAST(count(f) AS BIGINT) AS n, round(CAST(count(f) AS DOUBLE) / 25, 9) AS valid_fraction, round(avg(f) / pi(), 9) AS mean, round(max(f) / pi(), 9) AS max FROM w GROUP BY ALL", BOTH, f"{COARSE_CELLS}, {ANCHORS}")
def sliding_box(t):
    return windows2d.sliding_box(t("fx_coarse"), "r", "c", "coarse_rrs560", N, N).select("anchor_row", "anchor_col", "n", *rounded(9, "valid_fraction"), *as_rrs(9, "mean", "max"))


@query(
    "SELECT sensor, anchor_row, anchor_col, CAST(count(f) AS BIGINT) AS n, round(avg(f) / pi(), 9) AS mean, round(max(f) / pi(), 9) AS max FROM w GROUP BY ALL",
    BOTH,
    """shaped AS (SELECT sensor, n_cols, (SELECT max(coarse_index) FROM fx_coarse) // n_cols + 1 AS n_rows FROM (VALUES ('narrow', 24), ('wide', 32)) v(sensor, n_cols)),
 cells AS (SELECT sensor, n_rows, n_cols, coarse_index // n_cols AS r, coarse_index % n_cols AS c, coarse_rrs560 AS f FROM fx_coarse, shaped),
 o AS (SELECT a.i AS dr, b.i AS dc FROM range(0, 5) a(i), range(0, 5) b(i)),
 w AS (SELECT sensor, r - dr AS anchor_row, c - dc AS anchor_col, f FROM cells, o WHERE r - dr BETWEEN 0 AND n_rows - 5 AND c - dc BETWEEN 0 AND n_cols - 5)""",
)
def granule_windows(t):
    """One flat field as the native grids of two sensors, 24 and 32 cells wide: windows end at their own granule's edges."""
    sensor = F.explode(F.array(F.struct(F.lit("narrow").alias("sensor"), F.lit(24).alias("n_cols")), F.struct(F.lit("wide").alias("sensor"), F.lit(32).alias("n_cols")))).alias("s")
    cells = t("fx_coarse").select(F.lit("s").alias("scene"), sensor, "coarse_index", "coarse_rrs560").select("scene", "s.*", "coarse_index", "coarse_rrs560")
    shapes = cells.groupBy("scene", "sensor", "n_cols").agg((F.floor(F.max("coarse_index") / F.col("n_cols")) + 1).alias("n_rows"))
    granules = stages.shaped(cells.drop("n_cols"), shapes)
    out = windows2d.sliding_box(granules, "row", "col", "coarse_rrs560", F.col("n_rows"), F.col("n_cols"), keys=["scene", "sensor"])
    return out.select("sensor", "anchor_row", "anchor_col", "n", *as_rrs(9, "mean", "max"))


@query(
    f"SELECT r - dr AS anchor_row, c - dc AS anchor_col, CAST(count(coarse_rrs560) AS BIGINT) AS n, round(min(coarse_rrs560) / pi(), 9) AS min, round(max(coarse_rrs560) / pi(), 9) AS max FROM fx_coarse, o WHERE r - dr BETWEEN 0 AND {N - 7} AND c - dc BETWEEN 0 AND {N - 9} GROUP BY ALL",
    BOTH,
    "o AS (SELECT a.i AS dr, b.i AS dc FROM range(0, 7) a(i), range(0, 9) b(i))",
)
def sliding_extremes(t):
    out = windows2d.sliding_extremes(t("fx_coarse"), "r", "c", "coarse_rrs560", N, N, 7, 9)
    return out.select("anchor_row", "anchor_col", "n", *as_rrs(9, "min", "max"))


@query("SELECT anchor_row, anchor_col, round(fraction, 9) AS valid_fraction, round(cv, 8) AS cv FROM b", BOTH, f"{COARSE_CELLS}, {ANCHORS}, {trimmed('f', 'b')}")
def box_cv(t):
    return windows2d.box_cv(t("fx_coarse"), "r", "c", "coarse_rrs560", N, N).select("anchor_row", "anchor_col", *rounded(9, "valid_fraction"), *rounded(8, "cv"))


TABLE = f"""{FRAME},
 cells AS (SELECT f.r, f.c, coarse_rrs560 AS f, CASE WHEN green_blue_mean BETWEEN {CONFIG.mean_low} AND {CONFIG.mean_high} THEN green_blue_mean END AS gm, CASE WHEN green_blue_mean BETWEEN {CONFIG.mean_low} AND {CONFIG.mean_high} THEN green_blue_std / nullif(abs(green_blue_mean), 0) END AS gw,
  CASE WHEN rrs_mean_560 > 0 THEN rrs_mean_560 END AS bm, CASE WHEN rrs_mean_560 > 0 THEN rrs_std_560 / rrs_mean_560 END AS bw, frac_water FROM frame f LEFT JOIN fx_coarse k ON f.r = k.r AND f.c = k.c),
 {ANCHORS}, {trimmed('f', 'tf')}, {trimmed('gm', 'tg')}, {trimmed('bm', 'tb')},
 rest AS (SELECT anchor_row, anchor_col, max(gw) AS box_max_within_pixel_cv, max(gw) FILTER (WHERE dr = 2 AND dc = 2) AS centre_within_pixel_cv, max(frac_water) FILTER (WHERE dr = 2 AND dc = 2) AS centre_frac_water, max(bw) FILTER (WHERE dr = 2 AND dc = 2) AS band_centre_within_pixel_cv FROM w GROUP BY ALL),
 boxes AS (SELECT anchor_row, anchor_col, tf.fraction AS box_valid_fraction, tf.cv AS between_pixel_cv, tg.cv AS fine_between_pixel_cv, tb.cv AS band_between_pixel_cv, band_centre_within_pixel_cv, centre_within_pixel_cv, box_max_within_pixel_cv, centre_frac_water, tf.cv < 0.15 AS passes_filter
  FROM rest JOIN tf USING (anchor_row, anchor_col) JOIN tg USING (anchor_row, anchor_col) JOIN tb USING (anchor_row, anchor_col) WHERE tf.cv IS NOT NULL AND centre_within_pixel_cv IS NOT NULL)"""
CVS = ["between_pixel_cv", "fine_between_pixel_cv", "band_between_pixel_cv", "band_centre_within_pixel_cv", "centre_within_pixel_cv", "box_max_within_pixel_cv", "centre_frac_water"]


def boxes(t):
    cells = frame(t).join(t("fx_coarse").select("r", "c", "coarse_rrs560"), ["r", "c"], "left")
    return windows2d.homogeneity_table(cells, "r", "c", N, N, filter_on="coarse_rrs560", mean="green_blue_mean", within="green_blue_cv", band_mean="rrs_mean_560", band_std="rrs_std_560", config=CONFIG)


@query("SELECT anchor_row, anchor_col, round(box_valid_fraction, 9) AS box_valid_fraction, " + ", ".join(f"round({c}, 8) AS {c}" for c in CVS) + ", passes_filter FROM boxes", BOTH, TABLE)
def homogeneity_table(t):
    return boxes(t).select("anchor_row", "anchor_col", *rounded(9, "box_valid_fraction"), *rounded(8, *CVS), "passes_filter")


PASS = "FILTER (WHERE passes_filter)"
LIKE = "FILTER (WHERE passes_filter AND fine_between_pixel_cv IS NOT NULL)"
BAND = "FILTER (WHERE passes_filter AND band_between_pixel_cv IS NOT NULL AND band_centre_within_pixel_cv IS NOT NULL)"


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS n_boxes, CAST(count(*) {PASS} AS BIGINT) AS n_passing, round(CAST(count(*) {PASS} AS DOUBLE) / nullif(count(*), 0), 8) AS pass_rate, round(median(between_pixel_cv) {PASS}, 8) AS median_between,
 CAST(count(*) {LIKE} AS BIGINT) AS n_like_for_like, round(median(fine_between_pixel_cv) {LIKE}, 8) AS median_fine_between, round(median(centre_within_pixel_cv) {LIKE} / nullif(median(fine_between_pixel_cv) {LIKE}, 0), 7) AS within_over_between,
 CAST(count(*) {BAND} AS BIGINT) AS n_band, round(median(band_centre_within_pixel_cv) {BAND} / nullif(median(band_between_pixel_cv) {BAND}, 0), 7) AS within_over_between_band, round(median(centre_within_pixel_cv) {PASS}, 8) AS median_within,
 round(quantile_cont(centre_within_pixel_cv, 0.9) {PASS}, 8) AS p90_within, round(avg(CASE WHEN centre_within_pixel_cv > 0.15 THEN 1.0 ELSE 0.0 END) {PASS}, 8) AS frac_centre_above, round(avg(CASE WHEN box_max_within_pixel_cv > 0.15 THEN 1.0 ELSE 0.0 END) {PASS}, 8) AS frac_any_above FROM boxes""",
    BOTH,
    TABLE,
)
def box_summary(t):
    out = windows2d.box_summary(boxes(t))
    return out.select("n_boxes", "n_passing", "n_like_for_like", "n_band", *rounded(7, "within_over_between", "within_over_between_band"), *rounded(8, "pass_rate", "median_between", "median_fine_between", "median_within", "p90_within", "frac_centre_above", "frac_any_above"))


@query("SELECT CAST(anchor_col % 2 AS BIGINT) AS scene, round(median(centre_within_pixel_cv), 8) AS median_within, CAST(CASE WHEN anchor_col % 2 = 0 THEN 0.05 END AS DOUBLE) AS floor, round(median(centre_within_pixel_cv) / CASE WHEN anchor_col % 2 = 0 THEN 0.05 END, 7) AS multiple FROM boxes GROUP BY anchor_col % 2", BOTH, TABLE)
def noise_multiple(t):
    floors = t("region").where("r_regionkey = 0").select(F.lit(0).cast("long").alias("scene"), F.lit(0.05).alias("floor"))
    out = windows2d.noise_multiple(boxes(t).withColumn("scene", F.pmod(F.col("anchor_col"), F.lit(2).cast("long"))), floors, ["scene"])
    return out.select("scene", *rounded(8, "median_within"), "floor", *rounded(7, "multiple"))


@query("SELECT a.r, a.c, round(abs(a.coarse_rrs560 - b.coarse_rrs560) / pi(), 9) AS difference FROM fx_coarse a JOIN fx_coarse b ON a.r = b.r AND a.c = b.c + 1", BOTH)
def adjacent_diff(t):
    return windows2d.adjacent_diff(t("fx_coarse"), "r", "c", "coarse_rrs560").select("r", "c", *as_rrs(9, "difference"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_adjacent_pairs, round(median(abs(a.coarse_rrs560 - b.coarse_rrs560)) / pi(), 9) AS neighbour_difference, count(*) >= 50 AS assessable FROM fx_coarse a JOIN fx_coarse b ON a.r = b.r AND a.c = b.c + 1", BOTH)
def structure_neighbours(t):
    return windows2d.structure_score(t("fx_coarse"), "r", "c", "coarse_rrs560").select("n_adjacent_pairs", *as_rrs(9, "neighbour_difference"), "assessable")


@query(
    """SELECT CAST(n AS BIGINT) AS n_adjacent_pairs, round(own, 9) AS neighbour_difference, round(other, 9) AS shuffled_difference, round(own / nullif(other, 0), 9) AS ratio, n >= 50 AS assessable
 FROM (SELECT count(*) AS n, median(abs(a.v - b.v)) AS own FROM cells a JOIN cells b ON a.r = b.r AND a.c = b.c + 1), (SELECT median(abs(a.v - b.v)) AS other FROM dealt a JOIN dealt b ON a.r = b.r AND a.c = b.c + 1)""",
    BOTH,
    "cells AS (SELECT r, c, coarse_rrs560 AS v, row_number() OVER (ORDER BY r, c) - 1 AS i, count(*) OVER () AS n FROM fx_coarse),\n" + permuted_sql("cells", "i", "i", "n") + ",\ndealt AS (SELECT p.r, p.c, o.v FROM cells o JOIN walked USING (i) JOIN cells p ON p.i = place)",
    recursive=True,
)
def structure_score(t):
    return windows2d.structure_score(t("fx_coarse"), "r", "c", "coarse_rrs560").select("n_adjacent_pairs", *rounded(9, "neighbour_difference", "shuffled_difference", "ratio"), "assessable")


@query(
    f"""SELECT 'V1' AS tag, CASE WHEN max(greatest(-least(w, s, e, n), 0)) < 1 THEN 'PASS' ELSE 'FAIL' END AS verdict
 FROM (SELECT 0.0003 * k * cos(radians(lat - 0.0003)) AS w, 0.0001 * k AS s, 0.0007 * k * cos(radians(lat - 0.0003)) AS e, -0.0005 * k AS n FROM fx_scenes, (SELECT {METRES_PER_DEGREE} / 30 AS k))
 UNION ALL SELECT 'V3', CASE WHEN n < 50 OR coalesce(other, 0) = 0 THEN 'NOT ASSESSABLE' WHEN own / other <= 0.75 THEN 'PASS' ELSE 'MIXED' END
 FROM (SELECT count(*) AS n, median(abs(a.v - b.v)) AS own FROM field a JOIN field b ON a.r = b.r AND a.c = b.c + 1), (SELECT median(abs(a.v - b.v)) AS other FROM dealt a JOIN dealt b ON a.r = b.r AND a.c = b.c + 1)
 UNION ALL SELECT 'V4', CASE WHEN min(m) >= 1.5 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT median(centre_within_pixel_cv) / 0.05 AS m FROM boxes GROUP BY anchor_col % 2)
 UNION ALL SELECT 'V5', 'ANSWERED' FROM (SELECT count(*) FROM boxes)""",
    (*BOTH, "fx_scenes"),
    f"{TABLE},\nfield AS (SELECT r, c, coarse_rrs560 AS v, row_number() OVER (ORDER BY r, c) - 1 AS i, count(*) OVER () AS n FROM fx_coarse),\n" + permuted_sql("field", "i", "i", "n") + ",\ndealt AS (SELECT p.r, p.c, o.v FROM field o JOIN walked USING (i) JOIN field p ON p.i = place)",
    recursive=True,
)
def compare_verdicts(t):
    """Verdicts of the gates over grids, boxes and structure, by tag."""
    scenes = t("fx_scenes")
    feet = scenes.select("scene_id", *((F.col(c) + d).alias(n) for n, c, d in (("west", "lon", -0.15), ("south", "lat", -0.1), ("east", "lon", 0.15), ("north", "lat", 0.1))))
    corner = F.explode(F.array(*(F.struct((F.col("lon") + a).alias("lon"), (F.col("lat") + b).alias("lat")) for a in (-0.1503, 0.1507) for b in (-0.1001, 0.0995)))).alias("p")
    margins = spectral.bbox_margin(scenes.select("scene_id", corner).select("scene_id", "p.*"), feet, ["scene_id"])
    halves = boxes(t).withColumn("scene", F.pmod(F.col("anchor_col"), F.lit(2).cast("long")))
    floors = scenes.sparkSession.createDataFrame([(0, 0.05), (1, 0.05)], "scene long, floor double")
    scores = windows2d.structure_score(t("fx_coarse").withColumn("scene", F.lit("s")), "r", "c", "coarse_rrs560", ["scene"])
    rows = [ledger.grid_gate(margins), ledger.structure_verdict(scores, ["scene"]), ledger.noise_verdict(windows2d.noise_multiple(halves, floors, ["scene"]), ["scene"]), ledger.answer_verdict(windows2d.box_summary(halves, ["scene"]), ["scene"])]
    return scenes.sparkSession.createDataFrame([(r["hypothesis"].split(" ")[0], r["verdict"]) for r in rows], "tag string, verdict string")
