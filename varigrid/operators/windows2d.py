"""Sliding two-dimensional windows over sparse grids.

A cell belongs to many windows, but it is sent only to the tiles that hold their anchors (about 1.3 tiles a cell):
the exchange is by tile, cells are exploded to anchors behind it, and the grouping by tile and anchor needs no
further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.config import BoxConfig
from varigrid.functions.nulls import finite, let, masked, ratio
from varigrid.functions.permutations import permuted
from varigrid.operators.binning import bucket_rank

#: Anchors on a side of a tile.
TILE = 32


def extent(n: int | Column) -> Column:
    """A grid's rows or columns: one number for all cells, or a column of them that gives each cell its own grid's."""
    return (n if isinstance(n, Column) else F.lit(n)).cast("long")


def anchored(cells: DataFrame, row: str, col: str, height: int, width: int, n_rows: int | Column, n_cols: int | Column, keys: Sequence[str] = (), wrap: bool = False, tile: int = TILE) -> DataFrame:
    """A row per cell and window that covers it: ``anchor_row, anchor_col`` (the window's first cell), ``dr, dc``.

    Windows lie fully inside the grid; with ``wrap`` columns go round. A grid's shape may be a column, so that grids of
    many shapes pass at once; a cell whose shape is null is in no window. The result is dealt by tile
    (``_tile_row, _tile_col``): group by :func:`window_keys` to stay within it.
    """
    r, c = F.col(row).cast("long"), F.col(col).cast("long")
    n_rows, n_cols = extent(n_rows), extent(n_cols)
    sent = _sent(cells, r, c, height, width, n_cols, keys, wrap, tile)
    rows = _anchor_rows(sent, r, height, n_rows, tile)
    return _anchor_cols(rows, c, width, n_cols, wrap, tile)


def _sent(cells: DataFrame, r: Column, c: Column, height: int, width: int, n_cols: Column, keys: Sequence[str], wrap: bool, tile: int) -> DataFrame:
    """Cells in the tiles that hold their windows' anchors: the one exchange."""
    # anchors of a cell are exploded to find the tiles that hold them: the distinct tile rows and columns
    down, right = (F.sequence(F.lit(0), F.lit(k - 1)) for k in (height, width))
    tiles = lambda at, k, wraps: F.array_distinct(F.transform(k, lambda d: F.floor((F.pmod(at - d, n_cols) if wraps else at - d) / F.lit(tile)).cast("long")))
    sent = cells.withColumn("_tile_row", F.explode(tiles(r, down, False))).withColumn("_tile_col", F.explode(tiles(c, right, wrap)))
    return sent.where(F.col("_tile_row") >= 0).repartition(*keys, "_tile_row", "_tile_col")


def _anchor_rows(sent: DataFrame, r: Column, height: int, n_rows: Column, tile: int) -> DataFrame:
    each = sent.withColumn("dr", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("anchor_row", r - F.col("dr"))
    return each.where((F.col("anchor_row") >= 0) & (F.col("anchor_row") <= n_rows - height) & (F.floor(F.col("anchor_row") / F.lit(tile)) == F.col("_tile_row")))


def _anchor_cols(each: DataFrame, c: Column, width: int, n_cols: Column, wrap: bool, tile: int) -> DataFrame:
    at = c - F.col("dc")
    each = each.withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("anchor_col", F.pmod(at, n_cols) if wrap else at)
    inside = F.lit(True) if wrap else (F.col("anchor_col") >= 0) & (F.col("anchor_col") <= n_cols - width)
    return each.where(inside & (F.floor(F.col("anchor_col") / F.lit(tile)) == F.col("_tile_col")))


def sliding_extremes(cells: DataFrame, row: str, col: str, value: str, n_rows: int | Column, n_cols: int | Column, height: int, width: int, keys: Sequence[str] = (), wrap: bool = False) -> DataFrame:
    """``n, min, max`` of the finite values in every window with a cell: what can be taken line by line.

    Values are first taken down each column of a tile, then along its rows of anchors, both behind the one exchange: a cell
    is exploded ``height`` times and a column's result ``width`` times, not each cell to all places of its windows. Windows
    lie fully inside the grid; with ``wrap`` columns go round, and ``width`` is at most their number.
    """
    keys = list(keys)
    shaped = cells.select(*keys, F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"), finite(F.col(value)).alias("_v"), *_shape(n_rows, n_cols))
    tall, wide = _shaped()
    sent = _sent(shaped, F.col("_r"), F.col("_c"), height, width, wide, keys, wrap, TILE)
    down = _anchor_rows(sent, F.col("_r"), height, tall, TILE).groupBy(*keys, "_tile_row", "_tile_col", "anchor_row", "_c", "_n_cols").agg(F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    each = _anchor_cols(down, F.col("_c"), width, wide, wrap, TILE)
    return each.groupBy(*window_keys(keys)).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max")).select(*keys, "anchor_row", "anchor_col", "n", "min", "max")



def _shape(n_rows: int | Column, n_cols: int | Column) -> tuple[Column, Column]:
    return extent(n_rows).alias("_n_rows"), extent(n_cols).alias("_n_cols")


def _shaped() -> tuple[Column, Column]:
    return F.col("_n_rows"), F.col("_n_cols")


def window_keys(keys: Sequence[str] = ()) -> list[str]:
    return [*keys, "_tile_row", "_tile_col", "anchor_row", "anchor_col"]


def moments(values: Column) -> Column:
    """``n, mean, std`` (population) of an array of doubles without nulls; mean and std are null if it is empty."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))

    def spread(m: Column) -> Column:
        var = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.nullif(F.size(values), F.lit(0))
        flat = F.array_min(values) == F.array_max(values)  # else rounding of the mean would leave a spread
        return F.struct(F.size(values).alias("n"), F.when(flat, F.array_min(values)).otherwise(m).alias("mean"), F.when(flat, F.lit(0.0)).otherwise(F.sqrt(var)).alias("std"))

    return let(mean, spread)


def trimmed_cv(values: Column, cells: int, min_valid: float, sigma: float = 1.5, iterations: int = 1) -> Column:
    """std / |mean| after ``iterations`` passes that keep what is within ``sigma`` deviations of the mean.

    ``values`` are a window's values without nulls; null if they are under ``min_valid`` of its ``cells``
    before the trim, or if the mean is 0.
    """

    def passes(array: Column, left: int) -> Column:
        if not left:
            return let(moments(array), lambda m: ratio(m["std"], F.abs(m["mean"])))
        return let(moments(array), lambda m: passes(F.filter(array, lambda x: F.abs(x - m["mean"]) <= sigma * m["std"]), left - 1))

    return F.when(ratio(F.size(values), F.lit(cells)) >= min_valid, passes(values, iterations))


def sliding_box(cells: DataFrame, row: str, col: str, value: str, n_rows: int | Column, n_cols: int | Column, box: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """``n, valid_fraction, mean, max`` of the finite values in every window with a cell; missing cells are invalid."""
    v = finite(F.col(value))
    each = anchored(cells.select(*keys, row, col, v.alias("_v"), *_shape(n_rows, n_cols)), row, col, box, box, *_shaped(), keys)
    out = each.groupBy(*window_keys(keys)).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.max("_v").alias("max"))
    return out.select(*keys, "anchor_row", "anchor_col", "n", ratio(F.col("n"), F.lit(box * box)).alias("valid_fraction"), "mean", "max")


def box_cv(cells: DataFrame, row: str, col: str, value: str, n_rows: int | Column, n_cols: int | Column, config: BoxConfig = BoxConfig(), keys: Sequence[str] = ()) -> DataFrame:
    """``valid_fraction, cv`` of every window with a cell: :func:`trimmed_cv` of the finite values."""
    k = config.box
    each = anchored(cells.select(*keys, row, col, finite(F.col(value)).alias("_v"), *_shape(n_rows, n_cols)), row, col, k, k, *_shaped(), keys)
    lists = each.groupBy(*window_keys(keys)).agg(F.collect_list("_v").alias("_vs"))
    cv = trimmed_cv(F.col("_vs"), k * k, config.min_valid_fraction, config.sigma, config.iterations)
    return lists.select(*keys, "anchor_row", "anchor_col", ratio(F.size("_vs"), F.lit(k * k)).alias("valid_fraction"), cv.alias("cv"))


def homogeneity_table(
    cells: DataFrame, row: str, col: str, n_rows: int | Column, n_cols: int | Column, *, filter_on: str, mean: str, within: str, band_mean: str, band_std: str, water: str = "frac_water", config: BoxConfig = BoxConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """What the filter sees of every box, and what it cannot see, from one pass over the windows.

    Three between-cell CVs (the filter's retrieval, the fine ratio, a plain band), the centre's and the largest
    within-cell CV, and the pass flag. Boxes without the filter's CV or the centre's are dropped.
    """
    k, half = config.box, config.box // 2
    ok = F.col(water) >= config.min_water_fraction if config.min_water_fraction is not None else F.lit(True)
    positive = F.when(finite(F.col(band_mean)) > 0, F.col(band_mean))
    shaped = cells.where(ok).select(
        *keys, row, col, finite(F.col(filter_on)).alias("_f"), masked(F.col(mean), F.col(mean), config.mean_low, config.mean_high).alias("_m"), masked(finite(F.col(within)), F.col(mean), config.mean_low, config.mean_high).alias("_w"),
        positive.alias("_b"), ratio(F.col(band_std), positive).alias("_bw"), F.col(water).alias("_water"), *_shape(n_rows, n_cols),
    )
    centre = (F.col("dr") == half) & (F.col("dc") == half)
    at_centre = lambda c: F.max(F.when(centre, F.col(c)))
    lists = anchored(shaped, row, col, k, k, *_shaped(), keys).groupBy(*window_keys(keys)).agg(
        F.collect_list("_f").alias("_fs"), F.collect_list("_m").alias("_ms"), F.collect_list("_b").alias("_bs"), at_centre("_w").alias("centre_within_pixel_cv"), F.max("_w").alias("box_max_within_pixel_cv"), at_centre("_water").alias("centre_frac_water"), at_centre("_bw").alias("band_centre_within_pixel_cv"),
    )
    cv = lambda c: trimmed_cv(F.col(c), k * k, config.min_valid_fraction, config.sigma, config.iterations)
    out = lists.select(
        *keys, "anchor_row", "anchor_col", ratio(F.size("_fs"), F.lit(k * k)).alias("box_valid_fraction"), cv("_fs").alias("between_pixel_cv"), cv("_ms").alias("fine_between_pixel_cv"), cv("_bs").alias("band_between_pixel_cv"),
        "band_centre_within_pixel_cv", "centre_within_pixel_cv", "box_max_within_pixel_cv", "centre_frac_water",
    ).dropna(subset=["between_pixel_cv", "centre_within_pixel_cv"])
    return out.withColumn("passes_filter", F.col("between_pixel_cv") < config.cv_threshold)


def box_summary(boxes: DataFrame, keys: Sequence[str] = (), threshold: float = 0.15) -> DataFrame:
    """Counts, pass rate, medians, ratios of medians and fractions of the passing boxes, by ``keys``.

    Missing values count as false in the fractions and stay in their denominators.
    """
    passing = F.col("passes_filter")
    like, band = passing & F.col("fine_between_pixel_cv").isNotNull(), passing & F.col("band_between_pixel_cv").isNotNull() & F.col("band_centre_within_pixel_cv").isNotNull()
    med = lambda where, c: F.median(F.when(where, F.col(c)))
    above = lambda c: F.avg(F.when(passing, F.coalesce(F.col(c) > threshold, F.lit(False)).cast("double")))
    return boxes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_boxes"), F.count_if(passing).alias("n_passing"), ratio(F.count_if(passing), F.count(F.lit(1))).alias("pass_rate"), med(passing, "between_pixel_cv").alias("median_between"), F.count_if(like).alias("n_like_for_like"),
        med(like, "fine_between_pixel_cv").alias("median_fine_between"), ratio(med(like, "centre_within_pixel_cv"), med(like, "fine_between_pixel_cv")).alias("within_over_between"), F.count_if(band).alias("n_band"),
        ratio(med(band, "band_centre_within_pixel_cv"), med(band, "band_between_pixel_cv")).alias("within_over_between_band"), med(passing, "centre_within_pixel_cv").alias("median_within"),
        F.percentile(F.when(passing, F.col("centre_within_pixel_cv")), 0.9).alias("p90_within"), above("centre_within_pixel_cv").alias("frac_centre_above"), above("box_max_within_pixel_cv").alias("frac_any_above"),
    )


def noise_multiple(boxes: DataFrame, floors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median within-cell CV over all boxes, and its multiple of the declared ``floor`` by ``keys``."""
    medians = boxes.groupBy(*keys).agg(F.median("centre_within_pixel_cv").alias("median_within"))
    return medians.join(floors.select(*keys, "floor"), list(keys), "left").withColumn("multiple", ratio(F.col("median_within"), F.col("floor")))


def adjacent_diff(cells: DataFrame, row: str, col: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``difference``: |value - value of the left neighbour| for each pair of finite cells side by side in a row."""
    w = W.partitionBy(*keys, row).orderBy(col)
    some = cells.select(*keys, row, col, finite(F.col(value)).alias("_v")).where("_v is not null")
    beside = F.col(col) - F.lag(col).over(w) == 1
    return some.withColumn("difference", F.when(beside, F.abs(F.col("_v") - F.lag("_v").over(w)))).where("difference is not null").drop("_v")


def shuffled(cells: DataFrame, row: str, col: str, value: str, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """The finite values dealt anew over the finite cells: the value of the i-th cell, by row and column, goes to the place
    that a seeded bijection gives i. Cells are ranked by row, with offsets; values then meet their places by rank, so
    any number of tasks share a scene."""
    keys = list(keys)
    some = cells.select(*keys, row, col, finite(F.col(value)).alias(value)).where(F.col(value).isNotNull())
    ranked = bucket_rank(some, F.col(row), [F.col(col)], "_rank", keys)
    sizes = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    sized = ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes), F.lit(True))  # without keys one row
    values = sized.select(*keys, permuted(F.col("_rank"), F.col("_cells"), seed).alias("_rank"), value)
    return ranked.select(*keys, row, col, "_rank").join(values, [*keys, "_rank"]).select(*keys, row, col, value)


def structure_score(cells: DataFrame, row: str, col: str, value: str, keys: Sequence[str] = (), seed: int = 0, min_pairs: int = 50) -> DataFrame:
    """Median adjacent difference over the same after a shuffle; below ``min_pairs`` pairs not assessable."""
    own = adjacent_diff(cells, row, col, value, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_adjacent_pairs"), F.median("difference").alias("neighbour_difference"))
    other = adjacent_diff(shuffled(cells, row, col, value, keys, seed), row, col, value, keys).groupBy(*keys).agg(F.median("difference").alias("shuffled_difference"))
    both = own.join(other, list(keys), "left") if keys else own.join(F.broadcast(other), F.lit(True))  # one row each
    enough = F.col("n_adjacent_pairs") >= min_pairs
    return both.withColumns({"assessable": enough, "ratio": F.when(enough, ratio(F.col("neighbour_difference"), F.col("shuffled_difference")))})
