"""Coverage gaps: nearest footprint centres, distances to footprints, membership."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrid.functions.geo import haversine_km, in_box, rect_gap_km
from varigrid.operators import nearest

#: Comparisons, of all points with all others, up to which the others travel with the plan as one array.
COMPARED = 10_000_000
ARRAY_ROWS = 5000


def _least(points: DataFrame, others: DataFrame, key: Sequence[str], value: Callable[[Column], Column], centre: tuple[Column, Column, Column], compared: int) -> DataFrame:
    """``key`` and ``best``, the least ``value`` of a point's and any other row, given as a struct; keys are unique.

    ``centre`` tells an other's longitude, latitude and reach in radians about it. Few others, and few comparisons
    in all (both are counted), travel with the plan as one array, and no point moves. Else cells of points meet cells of others
    (:mod:`varigrid.operators.nearest`), and a point is compared with the others that its cell cannot rule out, which are
    :data:`nearest.MET` at most but where more stand within one of the finest cells. Points without a position have no best.
    """
    lon, lat, reach = centre
    items = nearest.placed(others, lon, lat).withColumn("_r", reach)
    best = F.array_min(F.transform("_items", value))
    somewhere = nearest.known(F.col("_lon")) & nearest.known(F.col("_lat"))
    n = others.count()
    if n <= ARRAY_ROWS and points.count() * n <= compared:
        packed = items.agg(F.collect_list(F.struct(*(F.col(c) for c in others.columns))).alias("_items"))
        return points.join(F.broadcast(packed), F.lit(True)).select(*key, F.when(somewhere, best).alias("best"))
    met = nearest.nearest(nearest.placed(points, F.col("_lon"), F.col("_lat")), items).select(*key, best.alias("best"))
    return met.unionByName(points.where(~somewhere).select(*key), allowMissingColumns=True)


def nearest_scene(points: DataFrame, scenes: DataFrame, *, key: Sequence[str], lon: str = "lon", lat: str = "lat", compared: int = COMPARED) -> DataFrame:
    """``key`` with ``nearest_scene_id, nearest_scene_km, nearest_scene_place``; ties go to the lowest id.

    ``points`` has unique ``key``; ``scenes`` has ``scene_id`` (a string), ``place, lon, lat``. Of scenes at one position only the
    lowest id is met. Points without a position have no scene, scenes without one count for nothing.
    """
    string_ids(scenes, "scene_id")
    first = F.min(F.struct("scene_id", "place")).alias("s")
    s = scenes.groupBy(F.col("lon").alias("slon"), F.col("lat").alias("slat")).agg(first).select("s.scene_id", "s.place", "slon", "slat")
    placed = points.select(*key, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"))
    near = lambda x: F.struct(haversine_km(F.col("_lat"), F.col("_lon"), x["slat"], x["slon"]).alias("km"), x["scene_id"].alias("id"), x["place"].alias("place"))
    out = _least(placed, s, key, near, (F.col("slon"), F.col("slat"), F.lit(0.0)), compared)
    return out.select(*key, F.col("best.id").alias("nearest_scene_id"), F.col("best.km").alias("nearest_scene_km"), F.col("best.place").alias("nearest_scene_place"))


def rect_gap(stations: DataFrame, footprints: DataFrame, *, key: Sequence[str], lon: str = "lon", lat: str = "lat", compared: int = COMPARED) -> DataFrame:
    """``key, km, inside``: distance from each station to the nearest footprint (``west, south, east, north``).

    Null where a station has no position; a footprint that lacks an edge counts for nothing. A footprint reaches at most half
    its height and half its width, as angles, from its centre, so cells bound the distance to its nearest point as well.
    """
    placed = stations.select(*key, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"))
    gap = lambda r: rect_gap_km(F.col("_lon"), F.col("_lat"), r["west"], r["south"], r["east"], r["north"])
    wide = F.col("east") - F.col("west") + F.when(F.col("west") > F.col("east"), 360.0).otherwise(0.0)
    tall = F.abs(F.col("north") - F.col("south"))
    centre = (F.col("west") + wide / 2, (F.col("south") + F.col("north")) / 2, F.least(F.radians((wide + tall) / 2), F.lit(2.0)))
    out = _least(placed, footprints.select("west", "south", "east", "north").distinct(), key, gap, centre, compared)
    return out.select(*key, F.col("best").alias("km"), (F.col("best") == 0).alias("inside"))


def stations_in_box(stations: DataFrame, west: float, south: float, east: float, north: float, weekly: str, *, lon: str = "lon", lat: str = "lat", kind: str = "kind") -> DataFrame:
    """``n_total, n_stations, n_weekly``: all stations, those in the box, and those of kind ``weekly`` in it."""
    inside = in_box(F.col(lon), F.col(lat), west, south, east, north)
    return stations.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(inside).alias("n_stations"), F.count_if(inside & (F.col(kind) == weekly)).alias("n_weekly"))


def string_ids(df: DataFrame, column: str) -> DataFrame:
    """``df`` itself, if ``column`` holds strings: an id such as 20250101_000000_01_0001 read as a number is lost."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError(f"ids in {column} are {df.schema[column].dataType.simpleString()}, not strings")
    return df
