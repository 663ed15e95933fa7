"""Exact distinct-entity counts in every sliding box on the globe, and the densest boxes kept apart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varigrid.config import SearchConfig
from varigrid.functions.geo import box_area_km2, in_box
from varigrid.functions.grids import cell_assign


@dataclass(frozen=True)
class Lattice:
    """The search grid that a configuration stands for."""

    n_lon: int
    n_lat: int
    win_x: int
    win_y: int
    wraps: bool
    separation: int

    @classmethod
    def of(cls, config: SearchConfig) -> Lattice:
        for name, extent in zip(("lon", "lat"), config.box_deg, strict=True):
            steps = extent / config.cell_deg
            if abs(steps - round(steps)) > 1e-9:
                raise ValueError(f"the box's {name} extent {extent} is not a whole multiple of the cell {config.cell_deg}")
        west, south, east, north = config.bounds
        n_lon, n_lat = round((east - west) / config.cell_deg), round((north - south) / config.cell_deg)
        win_x, win_y = (round(e / config.cell_deg) for e in config.box_deg)
        if win_y > n_lat or win_x > n_lon:
            raise ValueError(f"a box of {config.box_deg} degrees does not fit inside {config.bounds}")
        return cls(n_lon, n_lat, win_x, win_y, abs(east - west - 360.0) < 1e-9, round(config.min_separation_deg / config.cell_deg))

    @property
    def enough(self) -> int:
        """So many anchors can one pick suppress, itself included."""
        return (2 * self.separation - 1) ** 2 if self.separation else 1


def _runs(points: DataFrame, config: SearchConfig, id: str, lon: str, lat: str, keys: list[str]) -> DataFrame:
    """``keys, _row, _from, _to``: for each id, the anchors whose windows hold a point of it, as runs along rows that do not overlap."""
    grid = Lattice.of(config)
    cells = points.where(F.col(id).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        *keys, F.col(id).alias("_id"), cell_assign(F.col(lat), config.bounds[1], config.cell_deg, grid.n_lat).alias("_y"), cell_assign(F.col(lon), config.bounds[0], config.cell_deg, grid.n_lon).alias("_x")
    )
    rows = F.sequence(F.greatest(F.lit(0), F.col("_y") - (grid.win_y - 1)), F.least(F.col("_y"), F.lit(grid.n_lat - grid.win_y)))
    first, span = F.col("_x") - (grid.win_x - 1), lambda a, b: F.struct(a.cast("long").alias("_from"), b.cast("long").alias("_to"))
    straight = F.array(span(F.greatest(F.lit(0), first), F.col("_x")))
    spans = F.when(first < 0, F.concat(straight, F.array(span(first + grid.n_lon, F.lit(grid.n_lon - 1))))).otherwise(straight) if grid.wraps else straight
    beside = cells.distinct().where(F.col("_y") - (grid.win_y - 1) <= grid.n_lat - grid.win_y).select(*keys, "_id", F.explode(rows).alias("_row"), spans.alias("spans"))
    each = beside.select(*keys, "_id", "_row", F.explode("spans").alias("s")).select(*keys, "_id", "_row", "s.*")
    before = W.partitionBy(*keys, "_id", "_row").orderBy("_from", "_to").rowsBetween(W.unboundedPreceding, -1)
    new = each.withColumn("_from", F.greatest("_from", F.coalesce(F.max("_to").over(before) + 1, F.col("_from"))))
    return new.where(F.col("_from") <= F.col("_to")).select(*keys, "_row", "_from", "_to")


def distinct_id_windows(points: DataFrame, config: SearchConfig = SearchConfig(), *, id: str = "float_id", lon: str = "lon", lat: str = "lat", keys: Sequence[str] = ()) -> DataFrame:
    """``anchor_y, anchor_x, n_ids``: distinct ids with a point in the window of each anchor that has any.

    Points are reduced to distinct (id, cell) first, so a busy id or cell weighs no more than its cells. No id is counted
    window by window: its windows are united to runs along each row of anchors, a run adds one where it begins and takes one
    off behind its end, and sums along the row give the counts. Changes at one place are summed before they are
    shuffled, so neither a dense place nor a busy id fills a task; a row has at most as many places as the lattice has
    columns. Null ids and positions are left out. Longitude wraps on a whole globe, latitude never does.
    """
    keys = list(keys)
    ends = F.explode(F.array(F.struct(F.col("_from").alias("at"), F.lit(1).alias("by")), F.struct((F.col("_to") + 1).alias("at"), F.lit(-1).alias("by")))).alias("e")
    changes = _runs(points, config, id, lon, lat, keys).select(*keys, "_row", ends).groupBy(*keys, "_row", F.col("e.at").alias("_at")).agg(F.sum("e.by").alias("_by"))
    along = W.partitionBy(*keys, "_row").orderBy("_at")
    counts = changes.withColumn("n_ids", F.sum("_by").over(along)).withColumn("_next", F.lead("_at").over(along)).where("n_ids > 0")
    return counts.select(*keys, F.col("_row").alias("anchor_y"), F.explode(F.sequence(F.col("_at"), F.col("_next") - 1)).alias("anchor_x"), "n_ids")


def picked(ordered: list[tuple[int, int, int]], grid: Lattice, top_n: int) -> list[tuple[int, int, int]]:
    """The first ``top_n`` of (anchor_y, anchor_x, score) that keep their distance on one axis at least."""
    chosen: list[tuple[int, int, int]] = []
    for y, x, score in ordered:
        if len(chosen) == top_n or score == 0:
            break

        def apart(a: int, b: int) -> int:
            return min(abs(a - b), grid.n_lon - abs(a - b)) if grid.wraps else abs(a - b)

        if not any(abs(y - py) < grid.separation and apart(x, px) < grid.separation for py, px, _ in chosen):
            chosen.append((y, x, score))
    return chosen


def top_boxes(points: DataFrame, config: SearchConfig = SearchConfig(), *, id: str = "float_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``rank, lon_west, lon_east, lat_min, lat_max, wraps, n_points, n_ids, area_km2, score`` of the densest boxes.

    The order is by score, then flat index; a box whose anchor is closer than the separation on both axes to a
    chosen one is passed over. A pick suppresses a bounded number of anchors, so the first
    ``(top_n - 1) * enough + 1`` are all that the greedy choice can look at, however large the data; only these
    reach the driver. Points and ids are recounted with edges included. Fewer rows come back if there are no more.
    """
    grid = Lattice.of(config)
    counts = distinct_id_windows(points, config, id=id, lon=lon, lat=lat)
    flat = F.col("anchor_y") * grid.n_lon + F.col("anchor_x")
    need = (config.top_n - 1) * grid.enough + 1
    ordered = [(r["anchor_y"], r["anchor_x"], r["n_ids"]) for r in counts.orderBy(F.col("n_ids").desc(), flat).limit(need).collect()]
    rows = []
    for k, (y, x, score) in enumerate(picked(ordered, grid, config.top_n), 1):
        west, south = config.bounds[0] + x * config.cell_deg, config.bounds[1] + y * config.cell_deg
        east = west + config.box_deg[0]
        rows.append((k, west, east - 360.0 if grid.wraps and east > 180.0 else east, south, south + config.box_deg[1], score))
    boxes = points.sparkSession.createDataFrame(rows, "rank int, west double, east double, south double, north double, score long")
    held = points.select(F.col(id).alias("_id"), F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).join(F.broadcast(boxes), in_box(F.col("_lon"), F.col("_lat"), F.col("west"), F.col("south"), F.col("east"), F.col("north")))
    counted = held.groupBy("rank").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("_id").alias("n_ids"))
    out = boxes.join(counted, "rank", "left")
    rounded = lambda c: F.round(F.col(c), 4)
    return out.select(
        "rank", rounded("west").alias("lon_west"), rounded("east").alias("lon_east"), rounded("south").alias("lat_min"), rounded("north").alias("lat_max"), (F.col("west") > F.col("east")).alias("wraps"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.round(box_area_km2(F.col("west"), F.col("south"), F.col("east"), F.col("north")), 1).alias("area_km2"), "score",
    )


def reranked(boxes: DataFrame, by: str = "n_points") -> DataFrame:
    """The same boxes ranked anew by another column, ties by the former rank (a few rows: one window)."""
    from pyspark.sql import Window as W

    return boxes.withColumn("rank", F.row_number().over(W.orderBy(F.col(by).desc(), F.col("rank"))))


def describe_boxes(boxes: DataFrame, points: DataFrame, recent: Column, *, key: Sequence[str] = ("rank",), id: str = "float_id", lon: str = "lon", lat: str = "lat", time: str = "time", flag: str = "has_chla") -> DataFrame:
    """``boxes`` (a few dozen rows) with what each holds: flagged points and ids, time span, recent points and ids.

    Boxes are broadcast and met in one scan of the points; a box without points keeps zero counts. Boxes that
    cross the antimeridian hold both their parts.
    """
    b = boxes.select(*key, "lon_west", "lon_east", "lat_min", "lat_max")
    p = points.select(F.col(id).alias("_id"), F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), F.col(time).alias("_time"), F.col(flag).alias("_flag"), recent.alias("_recent"))
    held = p.join(F.broadcast(b), in_box(F.col("_lon"), F.col("_lat"), F.col("lon_west"), F.col("lat_min"), F.col("lon_east"), F.col("lat_max")))
    told = held.groupBy(*key).agg(
        F.count_if("_flag").alias("flagged_points"), F.countDistinct(F.when(F.col("_flag"), F.col("_id"))).alias("flagged_ids"), F.min("_time").alias("first_seen"), F.max("_time").alias("last_seen"),
        F.count_if("_recent").alias("recent_points"), F.countDistinct(F.when(F.col("_recent"), F.col("_id"))).alias("recent_ids"),
    )
    return boxes.join(told, list(key), "left").fillna(0, ["flagged_points", "flagged_ids", "recent_points", "recent_ids"])
