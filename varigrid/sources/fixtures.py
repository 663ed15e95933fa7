"""Raster-like, index-like and station-like views derived from the star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and columns of the fine and the coarse grid.
FINE, COARSE = 96, 24

SQL = {
    "fx_pixels": """
SELECT y, x, CAST(floor(y/4.0) AS BIGINT) AS r, CAST(floor(x/4.0) AS BIGINT) AS c,
 NOT (l_returnflag = 'R' AND (y + x) % 3 = 0) AS water,
 l_quantity/1000.0 + 0.01 AS b443, l_extendedprice/1000000.0 + 0.02 AS b490,
 l_extendedprice*(1-l_discount)/1000000.0 + 0.02 AS b560, l_extendedprice*l_tax/1000000.0 + 0.005 AS b665,
 l_discount/10.0 + 0.001 AS b865
FROM (SELECT *, (l_partkey*11 + l_suppkey*5) % 96 AS y, (l_orderkey*7 + l_linenumber*13) % 96 AS x FROM {lineitem}) t
WHERE (CAST(floor(y/4.0) AS BIGINT)*5 + CAST(floor(x/4.0) AS BIGINT)*3) % 11 <> 0
 AND NOT (y BETWEEN 32 AND 55 AND x BETWEEN 32 AND 55)""",
    "fx_coarse": """
SELECT r, c, r*24 + c AS coarse_index, avg(b560) * (1 + CAST(((r*7 + c*13) % 10)*r AS DOUBLE)/300) AS coarse_rrs560,
 avg(b490) * (1 + CAST(((r*3 + c*5) % 10)*c AS DOUBLE)/400) AS coarse_rrs490 FROM {fx_pixels} WHERE water GROUP BY r, c""",
    "fx_profiles": """
SELECT user_id AS float_id, event_id AS profile_id, ts AS time, event_type AS parameters,
 CAST(((user_id % 12)*300 + (user_id*7 + event_id) % 5 + 3598) % 3600 AS DOUBLE)/10 - 179.95 AS lon,
 CAST(600 + (user_id % 12)*40 + event_id % 4 AS DOUBLE)/10 - 89.95 AS lat FROM {events}""",
    "fx_scenes": """
SELECT concat('S_', CAST(s_suppkey AS STRING), '_4001') AS scene_id, s_name AS place,
 CAST((s_suppkey*97) % 3600 AS DOUBLE)/10 - 180 AS lon, CAST((s_suppkey*31) % 1400 AS DOUBLE)/10 - 70 AS lat FROM {supplier}""",
    "fx_stations": """
SELECT n_nationkey AS station, n_regionkey AS kind, CAST((n_nationkey*97 + n_nationkey % 3) % 3600 AS DOUBLE)/10 - 180 AS lon,
 CAST((n_nationkey*31 + n_nationkey % 4) % 1400 AS DOUBLE)/10 - 70 AS lat FROM {nation}""",
}
#: What each view reads, views before tables.
READS = {"fx_pixels": "lineitem", "fx_coarse": "fx_pixels", "fx_profiles": "events", "fx_scenes": "supplier", "fx_stations": "nation"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view (or base table) ``name`` over the Parquet tables of ``sf_dir``."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{READS[name]: view(spark, sf_dir, READS[name])})


def scratch(spark: SparkSession) -> str:
    """A new folder for the files of a round trip: in ``spark.checkpoint.dir``, or of this machine where all tasks run in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="varigrid-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def ctes(*names: str) -> str:
    """The views as common table expressions over tables of the same names, for another engine."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in SQL and name not in order:
            add(READS[name])
            order.append(name)

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({SQL[n].format(**{READS[n]: READS[n]})})" for n in order)
