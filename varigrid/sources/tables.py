"""Readers with explicit schemas: ids stay strings, missing values are NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.functions.geo import POLAR, unprojected
from varigrid.functions.nulls import denan
from varigrid.functions.text import flag_contains, squeezed
from varigrid.operators.coverage import string_ids

STATIONS = "station string, kind string, lat double, lon double, depth_m double, sampling string, source string"
INVENTORY = "id string, dt string, bbox array<double>, loc string"
INDEX = ("PLATFORM_NUMBER", "LATITUDE", "LONGITUDE", "TIME", "parameters")


def aggregates(spark: SparkSession, path: str) -> DataFrame:
    """Aggregate frames written by :func:`write_aggregates` (or any Parquet files under ``path``), NaN as NULL."""
    return denan(spark.read.option("recursiveFileLookup", "false").parquet(path))


def write_aggregates(df: DataFrame, path: str, keys: Sequence[str] = ("scene", "sensor")) -> None:
    """Parquet in a folder for each key; only the written partitions are replaced."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def stations(spark: SparkSession, path: str) -> DataFrame:
    """In-situ stations from CSV with quoted commas."""
    return spark.read.schema(STATIONS).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def inventory(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``scene_id, date, place, west, south, east, north, lon, lat`` (the centre) of a JSON array of scenes, or of one a line.

    Ids are read under a schema as strings; an id that is a bare number in the file would come out as its
    digits, so ids without the pattern's separators are refused by the first action on the result.
    """
    raw = spark.read.schema(INVENTORY).json(path, multiLine=not lines)
    box = lambda i: F.get("bbox", F.lit(i))
    checked = F.when(F.col("id").rlike("^[0-9.eE+]+$"), F.raise_error(F.concat(F.lit("a scene id was read as a number: "), "id"))).otherwise(F.col("id"))
    return raw.select(checked.cast("string").alias("scene_id"), F.col("dt").alias("date"), F.col("loc").alias("place"), box(0).alias("west"), box(1).alias("south"), box(2).alias("east"), box(3).alias("north"), *bbox_centre("bbox"))


def bbox_centre(column: str):
    """Centre longitude and latitude of an array (west, south, east, north), as ``lon`` and ``lat``."""
    at = lambda i: F.get(column, F.lit(i))
    return [((at(0) + at(2)) / 2).alias("lon"), ((at(1) + at(3)) / 2).alias("lat")]


def profile_index(raw: DataFrame, part: str = "CHLA") -> DataFrame:
    """``float_id, lat, lon, time, parameters, has_chla`` of an index with the columns :data:`INDEX`.

    Times that cannot be read become null; rows without position or time go.
    """
    time = F.try_to_timestamp(F.col("TIME")) if dict(raw.dtypes)["TIME"] == "string" else F.col("TIME")
    out = denan(raw, "LATITUDE", "LONGITUDE").select(F.col("PLATFORM_NUMBER").cast("string").alias("float_id"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), time.alias("time"), "parameters", flag_contains(F.col("parameters"), part).alias("has_chla"))
    return out.dropna(subset=["lat", "lon", "time"])


def load_index(spark: SparkSession, subset: str, full: str | None = None) -> DataFrame:
    """The index from its cached subset, or cut from the full one (five columns) and written there first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(subset)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if full is None:
            raise FileNotFoundError(f"no profile index at {subset}")
        spark.read.parquet(full).select(*INDEX).write.parquet(subset)
    return profile_index(spark.read.parquet(subset))


def grid_mesh(lon: DataFrame, lat: DataFrame) -> DataFrame:
    """``row, col, coarse_index, lon, lat`` of a regular grid from its axes (``col, lon``) and (``row, lat``).

    The shorter axis is broadcast; an axis is a vector of a file's header.
    """
    n = lon.agg((F.max("col") + 1).cast("long").alias("n_lon"))
    both = lat.join(F.broadcast(lon), F.lit(True)).join(F.broadcast(n), F.lit(True))
    return both.select("row", "col", (F.col("row") * F.col("n_lon") + F.col("col")).cast("long").alias("coarse_index"), "lon", "lat")


def attach_coarse(frame: DataFrame, coarse: DataFrame, index: str = "coarse_index", prefixes: Sequence[str] = ("RRS", "Rrs"), wanted: Sequence[str] = ("CHL", "chlor_a"), keys: Sequence[str] = ()) -> DataFrame:
    """``frame`` with the coarse sensor's retrievals as ``coarse_<name>``, by ``keys`` (a scene and sensor, say) and index."""
    names = [c for c in coarse.columns if c.startswith(tuple(prefixes)) or c in wanted]
    if not names:
        return frame
    return frame.join(coarse.select(*keys, index, *(F.col(c).alias(f"coarse_{c}") for c in names)), [*keys, index], "left")


def read_metrics(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The rows of a document of :func:`varigrid.operators.ledger.write_metrics`: ``keys`` as strings and the fields of ``schema``."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(': '.join(x.split()) for x in schema.split(','))}>>")).alias("k", "v"))
    parts = F.split("k", "/")
    return rows.select(*(F.get(parts, i).alias(k) for i, k in enumerate(keys)), "v.*")


def coarse_shapes(spark: SparkSession, path: str) -> DataFrame:
    """``scene, sensor, n_rows, n_cols`` from a ledger of the aggregate stage: the shape of each granule's native grid."""
    return read_metrics(spark, path, ["scene", "sensor"], "n_rows bigint, n_cols bigint")


@dataclass(frozen=True)
class Grid:
    """A corner-registered grid: its projection's EPSG code, pixel sizes in metres, the outer corner of pixel (0, 0) and its shape."""

    epsg: int
    dx: float
    dy: float
    x0: float
    y0: float
    n_x: int
    n_y: int

    def corners(self) -> list[tuple[float, float]]:
        return [(self.x0 + i * self.dx, self.y0 + j * self.dy) for j in (0, self.n_y) for i in (0, self.n_x)]


def grid_header(table: Mapping[str, object]) -> Grid:
    """A grid from a header (a document read with :func:`load_config` or JSON): ``epsg`` of a UTM zone of either hemisphere or a
    polar projection, or a northern ``zone``, and ``dx, dy, x0, y0, n_x, n_y``."""
    epsg = int(table["epsg"]) if table.get("epsg") is not None else 32600 + int(table["zone"])
    if epsg not in POLAR and not (epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60):
        raise ValueError(f"not a projection that is known: {epsg}")
    return Grid(epsg, *(float(table[k]) for k in ("dx", "dy", "x0", "y0")), *(int(table[k]) for k in ("n_x", "n_y")))


def corners_frame(spark: SparkSession, grids: Mapping[str, Grid]) -> DataFrame:
    """``scene, lon, lat`` of the four corners of each scene's grid."""
    rows = [(k, g.epsg, float(x), float(y)) for k, g in grids.items() for x, y in g.corners()]
    frame = spark.createDataFrame(rows, "scene string, epsg int, x double, y double")
    lon, lat = unprojected(F.col("x"), F.col("y"), F.col("epsg"))
    return frame.select("scene", lon.alias("lon"), lat.alias("lat"))


@dataclass(frozen=True)
class Scene:
    """A configured scene."""

    key: str
    scene_id: str
    date: str
    bbox: tuple[float, ...]
    search_bbox: tuple[float, ...]
    role: str = ""
    cloud_percent: float | None = None
    extra: tuple[tuple[str, str], ...] = ()


def load_config(path: str) -> dict:
    """A YAML document; the parser is needed only here."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def load_scenes(table: dict, keys: Sequence[str] | None = None, id_field: str = "scene_id") -> list[Scene]:
    """Scenes of a configuration table in its order, or those of ``keys``; unknown keys and numeric ids are refused."""
    numeric = [k for k, e in table.items() if not isinstance(e[id_field], str)]
    if numeric:
        raise TypeError(f"ids of {numeric} were read as numbers; quote them")
    unknown = sorted(set(keys or ()) - set(table))
    if unknown:
        raise KeyError(f"unknown scenes {unknown}; there are {sorted(table)}")
    named = {id_field, "date", "bbox", "search_bbox", "role", "cloud_percent"}
    return [
        Scene(k, e[id_field], str(e["date"]), tuple(e["bbox"]), tuple(e.get("search_bbox", ())), " ".join(str(e.get("role", "")).split()), e.get("cloud_percent"), tuple((a, str(b)) for a, b in e.items() if a not in named))
        for k, e in ((k, table[k]) for k in (keys if keys is not None else table))
    ]


def scenes_frame(spark: SparkSession, scenes: Sequence[Scene]) -> DataFrame:
    rows = [(s.key, s.scene_id, s.date, *map(float, s.bbox), s.role, None if s.cloud_percent is None else float(s.cloud_percent)) for s in scenes]
    out = spark.createDataFrame(rows, "scene string, scene_id string, date string, west double, south double, east double, north double, role string, cloud_percent double")
    return string_ids(out.withColumn("role", squeezed(F.col("role"))), "scene_id")


def asset_url(base: str, scene_id: str, asset: str = "ortho_sr_hdf5") -> str:
    """Address of one asset under a configured base: a folder by scene, a file by scene and asset."""
    return f"{base.rstrip('/')}/{scene_id}/{scene_id}_{asset}"
