"""Masks, pedestals and spectra of fine samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.functions.nulls import finite, ratio
from varigrid.operators.quantiles import of_columns


def ndwi(green: Column, nir: Column) -> Column:
    """(green - nir) / (green + nir); null where the sum is 0."""
    return ratio(green - nir, green + nir)


def otsu_threshold(df: DataFrame, value: str, low: float, high: float, bins: int = 64, keys: Sequence[str] = ()) -> DataFrame:
    """``threshold``: the bin edge between ``low`` and ``high`` with the largest variance between the two sides.

    Only the histogram, at most ``bins`` rows a key, meets in one place. Ties go to the lowest edge.
    """
    width = (high - low) / bins
    v = finite(F.col(value))
    at = F.least(F.greatest(F.floor((v - low) / width), F.lit(0)), F.lit(bins - 1)).cast("long")
    hist = df.where(v.isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w, all_ = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    mid = F.col("n") * F.col("bin")
    run = hist.select(*keys, "bin", F.sum("n").over(w).alias("n0"), F.sum(mid).over(w).alias("s0"), F.sum("n").over(all_).alias("nn"), F.sum(mid).over(all_).alias("ss"))
    run = run.where("n0 < nn")
    gap = F.col("s0") / F.col("n0") - (F.col("ss") - F.col("s0")) / (F.col("nn") - F.col("n0"))
    score = F.col("n0").cast("double") * (F.col("nn") - F.col("n0")) * gap * gap
    best = run.groupBy(*keys).agg(F.max_by("bin", F.struct(F.round(score, 6), -F.col("bin"))).alias("bin"))
    return best.select(*keys, "bin", (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("threshold"))


def _extreme(cells: DataFrame, row: str, col: str, mask: str, keys: Sequence[str], offsets: Sequence[tuple[int, int]], grow: bool) -> DataFrame:
    """Cells set after a dilation (any neighbour set) or an erosion (all neighbours set; absent cells are unset)."""
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets)))
    sent = cells.where(mask).select(*keys, row, col, shift.alias("o"))
    sign = 1 if grow else -1
    moved = sent.groupBy(*keys, (F.col(row) + sign * F.col("o.a")).alias(row), (F.col(col) + sign * F.col("o.b")).alias(col)).agg(F.count(F.lit(1)).alias("_n"))
    return moved.where(F.lit(True) if grow else F.col("_n") == len(offsets)).drop("_n").withColumn(mask, F.lit(True))


CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


def binary_opening(cells: DataFrame, row: str, col: str, mask: str, keys: Sequence[str] = (), element: Sequence[tuple[int, int]] = CROSS) -> DataFrame:
    """``keys, row, col`` of the cells that survive an erosion and a dilation by ``element``; cells are unique."""
    eroded = _extreme(cells.select(*keys, row, col, mask), row, col, mask, keys, element, False)
    opened = _extreme(eroded, row, col, mask, keys, element, True)
    return opened.select(*keys, row, col)


def box_opening(cells: DataFrame, row: str, col: str, mask: str, height: int, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, row, col`` of the cells that survive an opening by a rectangle of ``height`` x ``width``; cells are unique.

    The rectangle is taken as two lines, and nothing is exploded to its offsets: an erosion keeps what lies far enough before
    the end of its run, a dilation what has an eroded cell near enough before it, first along one axis and then along the
    other. (An opening adds no cell, so only cells of the mask are asked.) Cells are sent once, to the tile that owns them
    and to those whose edge is near; tiles are eight times the rectangle's sides, so a cell goes to 1.6 tiles on average
    and a tile's size follows the rectangle's, not the grid's. The work a cell does not depend on the rectangle.
    """
    if height < 1 or width < 1:
        raise ValueError("the rectangle has no cells")
    keys, tiles = [*keys], ["_tile_row", "_tile_col"]
    r, c = F.col("_r"), F.col("_c")
    sides = {"_r": (max(64, 8 * (height - 1)), height - 1), "_c": (max(64, 8 * (width - 1)), width - 1)}
    near = lambda at: F.explode(F.sequence(*(F.floor((F.col(at) + by) / F.lit(sides[at][0])).cast("long") for by in (-sides[at][1], sides[at][1]))))
    sent = cells.where(mask).select(*keys, F.col(row).alias("_row"), F.col(col).alias("_col"), F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"))
    dealt = sent.withColumn("_tile_row", near("_r")).withColumn("_tile_col", near("_c")).repartition(*keys, *tiles)

    def eroded(df: DataFrame, flag: str, line: str, at: Column, k: int) -> DataFrame:
        """``flag`` of the cells that begin ``k`` set ones along the line."""
        across = [*keys, *tiles, line]
        runs = df.withColumn("_run", at - F.row_number().over(W.partitionBy(*across, flag).orderBy(at)))
        return runs.withColumn(flag, F.col(flag) & (F.max(at).over(W.partitionBy(*across, flag, "_run")) - at >= k - 1)).drop("_run")

    def dilated(df: DataFrame, flag: str, line: str, at: Column, k: int) -> DataFrame:
        """``flag`` of the cells with a set one among the last ``k`` along the line, themselves included."""
        before = W.partitionBy(*keys, *tiles, line).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(flag, F.coalesce(at - F.max(F.when(F.col(flag), at)).over(before) < k, F.lit(False)))

    out = dealt.withColumn("_set", F.lit(True))
    for step in (eroded, dilated):
        out = step(step(out, "_set", "_c", r, height), "_set", "_r", c, width)
    own = [F.floor(F.col(at) / F.lit(sides[at][0])) == F.col(t) for at, t in zip(("_r", "_c"), tiles, strict=True)]
    return out.where(F.col("_set") & own[0] & own[1]).select(*keys, F.col("_row").alias(row), F.col("_col").alias(col))


def dark_offset(df: DataFrame, bands: Mapping[str, str], keys: Sequence[str] = (), share: float = 0.01) -> DataFrame:
    """``band, pedestal``: the exact percentile of each band over the given (water) samples."""
    return of_columns(df, bands, "band", {"pedestal": share}, keys).drop("n")


def to_rrs(df: DataFrame, offsets: DataFrame, bands: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with each band less its pedestal and over pi, as ``rrs_<band>``.

    The offsets (a row for each band and key) are turned to one wide row a key and broadcast.
    """
    wide = offsets.groupBy(*keys).agg(*(F.max(F.when(F.col("band") == b, F.col("pedestal"))).alias(f"_off_{b}") for b in bands))
    met = df.join(F.broadcast(wide), list(keys)) if keys else df.join(F.broadcast(wide), F.lit(True))  # one row without keys
    return met.withColumns({f"rrs_{b}": (F.col(c) - F.col(f"_off_{b}")) / F.pi() for b, c in bands.items()}).drop(*(f"_off_{b}" for b in bands))


def water_spectrum(df: DataFrame, bands: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """``band, n, median, p1`` over the given (water) samples."""
    return of_columns(df, bands, "band", {"median": 0.5, "p1": 0.01}, keys)


def water_check(df: DataFrame, water: str, green: str, nir: str, uncertainty: str, keys: Sequence[str] = ()) -> DataFrame:
    """Water share, green over near infrared and relative uncertainty at green: medians over water."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count_if(F.col(water)).alias("n_water"), F.count(F.lit(1)).alias("n_valid"))
    wet = of_columns(df.where(water), {"g": green, "n": nir, "u": uncertainty}, "band", {"m": 0.5}, keys)
    wide = wet.groupBy(*keys).agg(*(F.max(F.when(F.col("band") == b, F.col("m"))).alias(f"_{b}") for b in "gnu"))
    met = counts.join(wide, keys, "left") if keys else counts.join(F.broadcast(wide), F.lit(True), "left")
    return met.select(*keys, "n_water", "n_valid", ratio(F.col("n_water"), F.col("n_valid")).alias("water_share"), ratio(F.col("_g"), F.col("_n")).alias("green_over_nir"), ratio(F.col("_u"), F.col("_g")).alias("relative_uncertainty"))


def water_mask(pixels: DataFrame, row: str, col: str, green: str, nir: str, *, flags: Sequence[str] = (), valid: str | None = None, keys: Sequence[str] = (), bins: int = 64, element: Sequence[tuple[int, int]] | tuple[int, int] | None = None) -> DataFrame:
    """``pixels`` (unique cells) with ``water``: the index of green and near infrared lies above the scene's threshold of
    Otsu, no cloud or cirrus flag in ``flags`` is set (a null flag, that is the fill value, counts as set), and the cell
    survives a binary opening by ``element``: offsets, a rectangle's height and width, or the cross if None. Invalid cells
    are dry."""
    keys = list(keys)
    index = ndwi(F.col(green), F.col(nir))
    good = F.col(valid) if valid else F.lit(True)
    for flag in flags:
        good = good & F.coalesce(F.col(flag) == 0, F.lit(False))
    marked = pixels.withColumn("_index", F.when(good, index))
    limits = otsu_threshold(marked, "_index", -1.0, 1.0, bins, keys).select(*keys, "threshold")
    met = marked.join(F.broadcast(limits), keys, "left") if keys else marked.join(F.broadcast(limits), F.lit(True), "left")  # a row a scene
    raw = met.withColumn("water", F.coalesce(F.col("_index") >= F.col("threshold"), F.lit(False)))
    if element and isinstance(element[0], int):
        opened = box_opening(raw, row, col, "water", *element, keys)
    else:
        opened = binary_opening(raw, row, col, "water", keys, element or CROSS)
    opened = opened.withColumn("_open", F.lit(True))
    return raw.drop("water", "_index", "threshold").join(opened, [*keys, row, col], "left").withColumn("water", F.coalesce("_open", F.lit(False))).drop("_open")


def bbox_margin(corners: DataFrame, boxes: DataFrame, keys: Sequence[str], pixel: float = 30.0, slack: float = 1.0) -> DataFrame:
    """How far the grid's corners (``lon, lat``) reach beyond the declared box (``west, south, east, north``), in pixels."""
    from varigrid.functions.geo import METRES_PER_DEGREE

    grid = corners.groupBy(*keys).agg(F.min("lon").alias("gw"), F.min("lat").alias("gs"), F.max("lon").alias("ge"), F.max("lat").alias("gn"), F.avg("lat").alias("mid"))
    met = grid.join(boxes, list(keys))
    per_lat, per_lon = F.lit(METRES_PER_DEGREE / pixel), F.lit(METRES_PER_DEGREE / pixel) * F.cos(F.radians("mid"))
    sides = {"west_px": (F.col("west") - F.col("gw")) * per_lon, "south_px": (F.col("south") - F.col("gs")) * per_lat, "east_px": (F.col("ge") - F.col("east")) * per_lon, "north_px": (F.col("gn") - F.col("north")) * per_lat}
    out = met.select(*keys, *(v.alias(k) for k, v in sides.items()))
    least = F.least(*sides)
    return out.withColumns({"worst_shortfall_px": F.greatest(-least, F.lit(0.0)) + F.lit(0.0), "widest_margin_px": F.greatest(*sides), "contains": least > -slack})
