"""The pipeline's stages as compositions of operators, each over all scenes and sensors at once.

Tables pass between them: fine samples -> aggregate frame -> box table -> summaries; an index -> ranked boxes. Gates
read tables, so a gate can be run again without the work before it. A stage records its verdicts before it raises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.config import BoxConfig, GateConfig, SearchConfig
from varigrid.functions.geo import projected, utm_forward
from varigrid.functions.grids import unravel
from varigrid.functions.nulls import masked
from varigrid.functions.nulls import ratio as ratio_of
from varigrid.operators import agreement, binning, coverage, density, ledger, spectral, variance, windows2d
from varigrid.sources import tables

KEYS = ["scene", "sensor"]
#: The four derived scalars: name, numerator and denominator in nm.
RATIOS = (("blue_green", 490.0, 560.0), ("green_blue", 560.0, 490.0), ("red_green", 665.0, 560.0), ("green_red", 560.0, 665.0))


def fetch_stage(opened: DataFrame, expected: Sequence[str], ledger_path: str, config: GateConfig = GateConfig()) -> DataFrame:
    """G0 of ``opened`` (``scene, opens, n_valid``, one row a scene): every expected scene is there, opens and holds valid water."""
    ledger.enforce(opened.sparkSession, ledger_path, [ledger.fetch_gate(opened, expected, config)])
    return opened


def mask_stage(pixels: DataFrame, green: str, nir: str, *, flags: Sequence[str] = (), valid: str | None = None, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """``pixels`` (``scene, row, col``) with ``water``, from :func:`varigrid.operators.spectral.water_mask`."""
    return spectral.water_mask(pixels, "row", "col", green, nir, flags=flags, valid=valid, keys=keys)


def check_stage(pixels: DataFrame, corners: DataFrame, boxes: DataFrame, ledger_path: str | None = None, config: GateConfig = GateConfig()) -> DataFrame:
    """V1 and V0 of every ``scene``: ``pixels`` has ``scene, water, green, nir, uncertainty``."""
    margins = spectral.bbox_margin(corners, boxes, ["scene"], slack=config.corner_slack_px)
    checks = spectral.water_check(pixels, "water", "green", "nir", "uncertainty", ["scene"])
    if ledger_path:
        ledger.enforce(pixels.sparkSession, ledger_path, [ledger.grid_gate(margins, config), ledger.water_gate(checks, config)])
    return checks.join(margins, "scene", "full")


def nearest(bands: Mapping[float, str], nm: float) -> str:
    """The column of the wavelength nearest to ``nm``; the first of equals."""
    return bands[min(bands, key=lambda w: (abs(w - nm), w))]


def aggregate_stage(pixels: DataFrame, centres: DataFrame, bands: Mapping[float, str], *, spacing: float | None = None, ratios: Sequence[tuple[str, float, float]] = RATIOS, zone: int | None = None, low: float = 400.0, high: float = 900.0) -> DataFrame:
    """The aggregate frame: ``pixels`` (``scene, x, y, water`` and the bands' columns) binned to ``centres``.

    ``centres`` has ``scene, sensor, coarse_index`` and ``cx, cy`` in metres, or ``lon, lat``; the projection is then its column
    ``epsg``, one for each scene (:func:`varigrid.functions.geo.projected` knows which), or a northern UTM zone: its column
    ``zone``, or ``zone`` for all. The reach of the join is each granule's own median spacing (of a
    scene and sensor, over all its centres), or ``spacing`` for all. The pedestal of each band (its first percentile
    over water) is taken off by scene and the rest divided by pi. Retrievals of the coarse sensor are attached by
    scene, sensor and index.
    """
    if "cx" not in centres.columns:
        if "epsg" in centres.columns:
            x, y = projected(F.col("lon"), F.col("lat"), F.col("epsg"))
        else:
            x, y = utm_forward(F.col("lon"), F.col("lat"), F.col("zone") if "zone" in centres.columns else zone)
        centres = centres.withColumns({"cx": x, "cy": y})
    used = {nm: c for nm, c in bands.items() if low <= nm <= high}
    named = {f"{nm:.0f}": c for nm, c in used.items()}
    offsets = spectral.dark_offset(pixels.where("water"), named, ["scene"])
    rrs = spectral.to_rrs(pixels, offsets, named, ["scene"])
    if spacing is None:
        reach = binning.granule_spacing(centres, KEYS, x="cx", y="cy").withColumnRenamed("spacing", "_spacing")
    else:
        reach = centres.select(*KEYS).distinct().withColumn("_spacing", F.lit(float(spacing)))
    placed = centres.select(*KEYS, "coarse_index", "cx", "cy").join(reach, KEYS)
    labelled = binning.nearest_join(rrs.join(reach, "scene"), placed, F.col("_spacing"), keys=KEYS)  # a row a granule: small, but the optimizer's to tell
    columns = {nm: f"rrs_{nm:.0f}" for nm in used}
    frame = binning.aggregate_scene(labelled, [*KEYS, "coarse_index"], columns, {n: (nearest(columns, a), nearest(columns, b)) for n, a, b in ratios})
    return tables.attach_coarse(frame, centres, keys=KEYS)


def ladder_patch(pixels: DataFrame, bands: Mapping[float, str], *, ratio: tuple[float, float] = (560.0, 490.0), band: float = 560.0, patch: int = 480, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """``scene, row, col, ratio, band`` of the water in each scene's central window: reflectances less their pedestal over pi,
    their ratio by sample, null outside its admissible range, and one band. ``pixels`` has ``scene, row, col, water``."""
    wanted = {f"{nm:.0f}": nearest(bands, nm) for nm in (*ratio, band)}
    wet = pixels.where("water")
    rrs = spectral.to_rrs(wet, spectral.dark_offset(wet, wanted, ["scene"]), wanted, ["scene"])
    value = ratio_of(F.col(f"rrs_{ratio[0]:.0f}"), F.col(f"rrs_{ratio[1]:.0f}"))
    told = rrs.select("scene", "row", "col", masked(value, value, low, high).alias("ratio"), F.col(f"rrs_{band:.0f}").alias("band"))
    corner = variance.centre_window(wet, "row", "col", patch, ["scene"])
    inside = told.join(F.broadcast(corner), "scene").withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")})  # a row a scene
    return inside.where((F.col("row") >= 0) & (F.col("row") < patch) & (F.col("col") >= 0) & (F.col("col") < patch)).drop("row0", "col0")


def agreement_stage(frame: DataFrame, fine: dict[float, str], coarse: dict[float, str], ledger_path: str | None = None, config: GateConfig = GateConfig(), sensor: str | None = "olci") -> DataFrame:
    """V2 from a saved frame: a row for each scene and band over the usable cells of ``sensor`` (of all, if None)."""
    usable = frame.where(F.col("frac_water") >= config.usable_fraction)
    if "sensor" in frame.columns and sensor:
        usable = usable.where(F.col("sensor") == sensor)
    stats = agreement.spectral_agreement(usable, fine, coarse, ["scene"], config.min_pairs)
    if ledger_path:
        ledger.enforce(frame.sparkSession, ledger_path, [ledger.agreement_verdict(agreement.agreement_gate(stats, config, ["scene"]), config)])
    return stats


def shaped(frame: DataFrame, shapes: DataFrame | tuple[int, int]) -> DataFrame:
    """``frame`` with its granules' ``n_rows, n_cols``, and ``row, col`` where it has only ``coarse_index``."""
    if isinstance(shapes, DataFrame):
        one = shapes.groupBy(*KEYS).agg(*(F.when(F.min(c) == F.max(c), F.max(c)).cast("long").alias(c) for c in ("n_rows", "n_cols")))
        known = frame.drop("n_rows", "n_cols").join(one, KEYS, "left")
        refused = F.raise_error(F.concat(F.lit("no shape, or more than one, of "), F.concat_ws("/", *KEYS)))
        known = known.withColumns({c: F.coalesce(c, refused.cast("long")) for c in ("n_rows", "n_cols")})
    else:
        known = frame.withColumns({c: F.lit(n).cast("long") for c, n in zip(("n_rows", "n_cols"), shapes, strict=True)})
    if "row" in frame.columns and "col" in frame.columns:
        return known
    at = unravel(F.col("coarse_index"), F.col("n_cols"))
    return known.withColumns({"row": at[0], "col": at[1]})


def compare_stage(
    frame: DataFrame, shapes: DataFrame | tuple[int, int], *, filter_on: Sequence[str] = ("coarse_RRS560", "coarse_Rrs_560", "coarse_CHL", "coarse_chlor_a"), ratio: str = "green_blue", band: str = "560", floors: DataFrame | None = None,
    ledger_path: str | None = None, boxes: BoxConfig = BoxConfig(), gates: GateConfig = GateConfig(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Box table, summary and structure scores of every scene and sensor, from a frame with ``row, col`` or ``coarse_index``.

    ``shapes`` has ``scene, sensor, n_rows, n_cols``, a row for each granule (:func:`varigrid.sources.tables.coarse_shapes` reads
    it from a ledger), or is one shape for all. Windows end at their own granule's edges, and a flat index is told apart
    to row and column by its own granule's width. A granule of the frame without a shape is an error, as are two shapes of
    one. ``floors`` has ``floor`` by ``scene``, and by ``sensor`` where it has that column.
    """
    chosen = agreement.first_column(frame, filter_on)
    frame = shaped(frame, shapes)
    table = windows2d.homogeneity_table(frame, "row", "col", F.col("n_rows"), F.col("n_cols"), filter_on=chosen, mean=f"{ratio}_mean", within=f"{ratio}_cv", band_mean=f"rrs_mean_{band}", band_std=f"rrs_std_{band}", config=boxes, keys=KEYS).withColumn("filter_on", F.lit(chosen))
    summary = windows2d.box_summary(table, KEYS, boxes.cv_threshold)
    masked = frame.withColumn("_cv", F.when(F.col(f"{ratio}_mean").between(boxes.mean_low, boxes.mean_high), F.col(f"{ratio}_cv")))
    scores = windows2d.structure_score(masked, "row", "col", "_cv", KEYS, min_pairs=gates.min_adjacent_pairs)
    if ledger_path:
        rows = [ledger.structure_verdict(scores, KEYS, gates), ledger.answer_verdict(summary, KEYS)]
        if floors is not None:
            by = [k for k in KEYS if k in floors.columns]
            rows.insert(1, ledger.noise_verdict(windows2d.noise_multiple(table, floors, by), by, gates))
        ledger.enforce(frame.sparkSession, ledger_path, rows)
    return table, summary, scores


def variance_stage(samples: DataFrame, scalars: Mapping[str, str], *, patch: int = 480, factors: Sequence[int] = (18, 40)) -> DataFrame:
    """Shares of variance between and within cells in each scene's central window of water (``scene, row, col``)."""
    corner = variance.centre_window(samples, "row", "col", patch, ["scene"])
    inside = samples.join(F.broadcast(corner), "scene").withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}).where((F.col("row") >= 0) & (F.col("row") < patch) & (F.col("col") >= 0) & (F.col("col") < patch))
    return variance.variance_ladder(inside, "row", "col", scalars, factors, patch, patch, ["scene"], patch)


def tasking_stage(index: DataFrame, scenes: DataFrame, recent: Column, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Ranked boxes by ids and by profiles, over all times and recent ones, described, with the nearest scene.

    The search runs once for each window of time; the order by profiles uses the same boxes.
    """
    out = None
    for window, points in (("all", index), ("recent", index.where(recent))):
        boxes = points.sparkSession.createDataFrame(density.top_boxes(points, config).collect(), density.top_boxes(points.limit(0), replace(config, top_n=1)).schema)  # top_n rows
        for metric, ranked in (("floats", boxes), ("profiles", density.reranked(boxes))):
            told = density.describe_boxes(ranked, index, recent).withColumns({"metric": F.lit(metric), "window": F.lit(window)})
            out = told if out is None else out.unionByName(told)
    key = ["metric", "window", "rank"]
    east = F.when(F.col("wraps"), F.col("lon_east") + 360).otherwise(F.col("lon_east"))
    middle = (F.col("lon_west") + east) / 2
    centred = out.select(*key, F.when(middle > 180, middle - 360).otherwise(middle).alias("lon"), ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"))
    return out.join(coverage.nearest_scene(centred, scenes, key=key), key)


def station_box(stations: DataFrame, footprints: DataFrame, centre: tuple[float, float], weekly: str, config: SearchConfig = SearchConfig()) -> tuple[DataFrame, DataFrame]:
    """The proposed box about ``centre`` with what it holds, and the stations' gaps to the existing footprints."""
    (lon, lat), (w, h) = centre, (e / 2 for e in config.box_deg)
    held = coverage.stations_in_box(stations, lon - w, lat - h, lon + w, lat + h, weekly)
    row = held.select(F.lit(1).alias("rank"), F.lit("in_situ_stations").alias("metric"), F.lit("proposed").alias("window"), F.lit(lon - w).alias("lon_west"), F.lit(lon + w).alias("lon_east"), F.lit(lat - h).alias("lat_min"), F.lit(lat + h).alias("lat_max"), "n_stations", "n_weekly")
    gaps = coverage.rect_gap(stations, footprints, key=["station"])
    return row, gaps.agg(F.count_if("inside").alias("n_inside"), F.min("km").alias("min_km"), F.median("km").alias("median_km"))


def proposal_stage(
    index: DataFrame, scenes: DataFrame, stations: DataFrame, footprints: DataFrame, *, recent: Column, centre: tuple[float, float], weekly: str, ledger_path: str | None = None, config: SearchConfig = SearchConfig(), max_km: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """:func:`tasking_stage` with the proposed box of the stations as one more row (what it lacks is null), the stations' gaps,
    and V6 over the best box and the proposed one."""
    boxes = tasking_stage(index, scenes, recent, config)
    row, gaps = station_box(stations, footprints, centre, weekly, config)
    both = boxes.unionByName(row, allowMissingColumns=True)
    if ledger_path:
        best = boxes.where((F.col("metric") == "floats") & (F.col("window") == "all")).orderBy("rank").limit(1).select("n_ids", "nearest_scene_km").first()
        held = row.select("n_stations").first()["n_stations"]
        ledger.enforce(index.sparkSession, ledger_path, [ledger.coverage_verdict(best["n_ids"] if best else 0, held, best["nearest_scene_km"] if best else None, max_km)])
    return both, gaps
