"""Queries over positions: density search, coverage gaps, geometry; and over the ledger and the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from varigrid.config import SearchConfig
from varigrid.functions import geo
from varigrid.functions.grids import cell_assign as cell
from varigrid.functions.text import first_token as token
from varigrid.functions.text import flag_contains as contains
from varigrid.operators import coverage, density, ledger
from varigrid.plans.registry import query, rounded
from varigrid.sources import tables
from varigrid.sources.fixtures import scratch

CONFIG = SearchConfig(box_deg=(0.3, 0.2), cell_deg=0.1, top_n=10, min_separation_deg=2.0)
P, S, T = ("fx_profiles",), ("fx_scenes",), ("fx_stations",)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371.0 * asin(sqrt(least(1, greatest(0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))))"


def area_sql(west: str, south: str, east: str, north: str) -> str:
    zone = lambda x: f"(sin(radians({x})) / (1 - {geo.E2!r} * sin(radians({x})) * sin(radians({x}))) + atanh({geo.E!r} * sin(radians({x}))) / {geo.E!r})"
    return f"({geo.B * geo.B / 2e6!r} * radians(CASE WHEN {west} <= {east} THEN {east} - {west} ELSE {east} - {west} + 360 END) * ({zone(north)} - {zone(south)}))"


@query("SELECT CAST(r_regionkey AS BIGINT) AS row, CAST(n_nationkey AS BIGINT) AS col, CAST(r_regionkey * 25 + n_nationkey AS BIGINT) AS coarse_index, CAST(n_nationkey AS DOUBLE) / 8 - 83 AS lon, 41.5 - CAST(r_regionkey AS DOUBLE) / 8 AS lat FROM region, nation")
def grid_mesh(t):
    lon = t("nation").select(F.col("n_nationkey").cast("long").alias("col"), (F.col("n_nationkey").cast("double") / 8 - 83).alias("lon"))
    lat = t("region").select(F.col("r_regionkey").cast("long").alias("row"), (F.lit(41.5) - F.col("r_regionkey").cast("double") / 8).alias("lat"))
    return tables.grid_mesh(lon, lat)


@query("SELECT CAST(float_id AS STRING) AS float_id, round(lat, 6) AS lat, round(lon, 6) AS lon, time, parameters, contains(parameters, 'click') AS has_chla FROM fx_profiles", P)
def profile_index(t):
    raw = t("fx_profiles").select(F.col("float_id").alias("PLATFORM_NUMBER"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), F.col("time").alias("TIME"), "parameters")
    return tables.profile_index(raw, "click").select("float_id", *rounded(6, "lat", "lon"), "time", "parameters", "has_chla")


@query("SELECT scene_id, round((lon - 0.15 + lon + 0.15) / 2, 6) AS lon, round((lat - 0.1 + lat + 0.1) / 2, 6) AS lat FROM fx_scenes", S)
def bbox_centre(t):
    boxed = t("fx_scenes").select("scene_id", F.array(F.col("lon") - 0.15, F.col("lat") - 0.1, F.col("lon") + 0.15, F.col("lat") + 0.1).alias("bbox"))
    return boxed.select("scene_id", *tables.bbox_centre("bbox")).select("scene_id", *rounded(6, "lon", "lat"))


@query(f"SELECT a.station, b.station AS other, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM fx_stations a JOIN fx_stations b ON a.kind = b.kind AND a.station < b.station", T)
def haversine(t):
    a, b = t("fx_stations"), t("fx_stations").select(F.col("station").alias("other"), "kind", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, "kind").where("station < other").select("station", "other", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query("SELECT float_id, profile_id FROM fx_profiles WHERE lat BETWEEN -30.1 AND -29.7 AND (lon >= 179.9 OR lon <= -179.8)", P)
def box_filter_wrap(t):
    return t("fx_profiles").where(geo.in_box(F.col("lon"), F.col("lat"), 179.9, -30.1, -179.8, -29.7)).select("float_id", "profile_id")


@query("SELECT contains(parameters, 'lic') AS flag, CAST(count(*) AS BIGINT) AS n FROM fx_profiles GROUP BY 1", P)
def flag_contains(t):
    return t("fx_profiles").groupBy(contains(F.col("parameters"), "lic").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT float_id, CAST(count(*) AS BIGINT) AS n, max(time) AS last_seen FROM fx_profiles WHERE time >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY float_id", P)
def recent_filter(t):
    return t("fx_profiles").where(F.col("time") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).groupBy("float_id").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last_seen"))


@query("SELECT least(greatest(CAST(floor((lat + 90) / 0.1) AS BIGINT), 0), 1799) AS cell_y, least(greatest(CAST(floor((lon + 180) / 0.1) AS BIGINT), 0), 3599) AS cell_x, CAST(count(*) AS BIGINT) AS n FROM fx_profiles GROUP BY ALL", P)
def cell_assign(t):
    return t("fx_profiles").groupBy(cell(F.col("lat"), -90, 0.1, 1800).alias("cell_y"), cell(F.col("lon"), -180, 0.1, 3600).alias("cell_x")).agg(F.count(F.lit(1)).alias("n"))


SCORE = """spots AS (SELECT DISTINCT float_id, least(greatest(CAST(floor((lat + 90) / 0.1) AS BIGINT), 0), 1799) AS cy, least(greatest(CAST(floor((lon + 180) / 0.1) AS BIGINT), 0), 3599) AS cx FROM fx_profiles WHERE float_id IS NOT NULL),
 score AS (SELECT cy - dy AS anchor_y, (cx - dx + 3600) % 3600 AS anchor_x, CAST(count(DISTINCT float_id) AS BIGINT) AS n_ids FROM spots, range(0, 2) a(dy), range(0, 3) b(dx) WHERE cy - dy BETWEEN 0 AND 1798 GROUP BY ALL)"""


@query("SELECT * FROM score", P, SCORE)
def distinct_id_windows(t):
    return density.distinct_id_windows(t("fx_profiles"), CONFIG)


def _greedy() -> str:
    """The greedy choice, a pick an expression."""
    out = [SCORE, "ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n_ids DESC, anchor_y * 3600 + anchor_x) AS rn FROM score)", "chosen1 AS MATERIALIZED (SELECT 1 AS k, * FROM ranked WHERE rn = 1)"]
    for k in range(2, CONFIG.top_n + 1):
        near = "abs(p.anchor_y - r.anchor_y) < 20 AND least(abs(p.anchor_x - r.anchor_x), 3600 - abs(p.anchor_x - r.anchor_x)) < 20"
        out.append(f"chosen{k} AS MATERIALIZED (SELECT * FROM chosen{k - 1} UNION ALL (SELECT {k}, * FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM chosen{k - 1} p WHERE {near}) ORDER BY rn LIMIT 1))")
    out.append(f"""edges AS (SELECT k, n_ids AS score, -180 + anchor_x * CAST(0.1 AS DOUBLE) AS west, CASE WHEN -180 + anchor_x * CAST(0.1 AS DOUBLE) + 0.3 > 180 THEN -180 + anchor_x * CAST(0.1 AS DOUBLE) + 0.3 - 360 ELSE -180 + anchor_x * CAST(0.1 AS DOUBLE) + 0.3 END AS east, -90 + anchor_y * CAST(0.1 AS DOUBLE) AS south, -90 + anchor_y * CAST(0.1 AS DOUBLE) + 0.2 AS north FROM chosen{CONFIG.top_n}),
 top AS (SELECT k, west, east, south, north, score, CAST(count(float_id) AS BIGINT) AS n_points, CAST(count(DISTINCT float_id) AS BIGINT) AS n_ids FROM edges LEFT JOIN fx_profiles ON lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END GROUP BY ALL)""")  # fmt: skip
    return ",\n".join(out)


BOXES = f"round(west, 4) AS lon_west, round(east, 4) AS lon_east, round(south, 4) AS lat_min, round(north, 4) AS lat_max, west > east AS wraps, n_points, n_ids, round({area_sql('west', 'south', 'east', 'north')}, 1) AS area_km2, score"


@query(f"SELECT CAST(k AS INT) AS rank, {BOXES} FROM top", P, _greedy())
def top_boxes(t):
    return density.top_boxes(t("fx_profiles"), CONFIG)


@query(f"SELECT CAST(row_number() OVER (ORDER BY n_points DESC, k) AS INT) AS rank, {BOXES} FROM top", P, _greedy())
def rerank_boxes(t):
    return density.reranked(density.top_boxes(t("fx_profiles"), CONFIG))


#: Boxes about the first clusters, one across the antimeridian, one empty; in SQL.
FIVE = """b AS (SELECT r_regionkey AS rank, CAST((r_regionkey * 300 + 3598) % 3600 AS DOUBLE) / 10 - 180 AS lon_west, CAST((r_regionkey * 300 + 3601) % 3600 AS DOUBLE) / 10 - 180 AS lon_east,
 CASE WHEN r_regionkey = 4 THEN 80.0 ELSE CAST(600 + r_regionkey * 40 AS DOUBLE) / 10 - 90 END AS lat_min, CASE WHEN r_regionkey = 4 THEN 81.0 ELSE CAST(602 + r_regionkey * 40 AS DOUBLE) / 10 - 90 END AS lat_max FROM region)"""


def five(t):
    k = F.col("r_regionkey")
    edge = lambda d: F.pmod(k * 300 + d, F.lit(3600)).cast("double") / 10 - 180
    lat = lambda d, far: F.when(k == 4, F.lit(far)).otherwise((d + k * 40).cast("double") / 10 - 90)
    return t("region").select(k.alias("rank"), edge(3598).alias("lon_west"), edge(3601).alias("lon_east"), lat(F.lit(600), 80.0).alias("lat_min"), lat(F.lit(602), 81.0).alias("lat_max"))


@query(
    """SELECT rank, CAST(count(*) FILTER (WHERE parameters = 'click') AS BIGINT) AS flagged_points, CAST(count(DISTINCT float_id) FILTER (WHERE parameters = 'click') AS BIGINT) AS flagged_ids, min(time) AS first_seen, max(time) AS last_seen,
 CAST(count(*) FILTER (WHERE time >= TIMESTAMP '2024-01-20 00:00:00') AS BIGINT) AS recent_points, CAST(count(DISTINCT float_id) FILTER (WHERE time >= TIMESTAMP '2024-01-20 00:00:00') AS BIGINT) AS recent_ids
 FROM b LEFT JOIN fx_profiles ON lat BETWEEN lat_min AND lat_max AND CASE WHEN lon_west <= lon_east THEN lon BETWEEN lon_west AND lon_east ELSE lon >= lon_west OR lon <= lon_east END GROUP BY rank""",
    P,
    FIVE,
)
def describe_boxes(t):
    points = t("fx_profiles").withColumn("has_chla", contains(F.col("parameters"), "click"))
    out = density.describe_boxes(five(t), points, F.col("time") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return out.select("rank", "flagged_points", "flagged_ids", "first_seen", "last_seen", "recent_points", "recent_ids")


@query(
    f"SELECT station, nearest_scene_id, round(km, 6) AS nearest_scene_km, place AS nearest_scene_place FROM (SELECT station, scene_id AS nearest_scene_id, place, km, row_number() OVER (PARTITION BY station ORDER BY km, scene_id) AS k FROM (SELECT station, scene_id, place, {haversine_sql('t.lat', 't.lon', 's.lat', 's.lon')} AS km FROM fx_stations t, fx_scenes s)) WHERE k = 1",
    T + S,
)
def nearest_scene(t):
    return coverage.nearest_scene(t("fx_stations"), t("fx_scenes"), key=["station"]).select("station", "nearest_scene_id", *rounded(6, "nearest_scene_km"), "nearest_scene_place")


@query(
    f"SELECT station, round(min({haversine_sql('t.lat', 't.lon', 'greatest(s.lat - 0.1, least(t.lat, s.lat + 0.1))', 'greatest(s.lon - 0.15, least(t.lon, s.lon + 0.15))')}), 6) AS km FROM fx_stations t, fx_scenes s GROUP BY station",
    T + S,
)
def rect_gap(t):
    feet = t("fx_scenes").select((F.col("lon") - 0.15).alias("west"), (F.col("lat") - 0.1).alias("south"), (F.col("lon") + 0.15).alias("east"), (F.col("lat") + 0.1).alias("north"))
    return coverage.rect_gap(t("fx_stations"), feet, key=["station"]).select("station", *rounded(6, "km"))


PS = P + S


@query(
    f"""SELECT profile_id, best.id AS nearest_scene_id, round(best.km, 6) AS nearest_scene_km, best.place AS nearest_scene_place FROM
 (SELECT profile_id, min({{'km': {haversine_sql('t.lat', 't.lon', 's.lat', 's.lon')}, 'id': scene_id, 'place': place}}) AS best FROM fx_profiles t, fx_scenes s GROUP BY profile_id)""",
    PS,
)
def nearest_scene_cells(t):
    """The nearest scene of every profile, by cells of profiles and of scenes."""
    return coverage.nearest_scene(t("fx_profiles"), t("fx_scenes"), key=["profile_id"], compared=0).select("profile_id", "nearest_scene_id", *rounded(6, "nearest_scene_km"), "nearest_scene_place")


@query(
    f"SELECT profile_id, round(km, 6) AS km, km = 0 AS inside FROM (SELECT profile_id, min({haversine_sql('t.lat', 't.lon', 'greatest(s.lat - 0.1, least(t.lat, s.lat + 0.1))', 'greatest(s.lon - 0.15, least(t.lon, s.lon + 0.15))')}) AS km FROM fx_profiles t, fx_scenes s GROUP BY profile_id)",
    PS,
)
def rect_gap_cells(t):
    """The gap from every profile to the nearest footprint, by cells of both."""
    feet = t("fx_scenes").select((F.col("lon") - 0.15).alias("west"), (F.col("lat") - 0.1).alias("south"), (F.col("lon") + 0.15).alias("east"), (F.col("lat") + 0.1).alias("north"))
    return coverage.rect_gap(t("fx_profiles"), feet, key=["profile_id"], compared=0).select("profile_id", *rounded(6, "km"), "inside")


@query("SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (WHERE inside) AS BIGINT) AS n_stations, CAST(count(*) FILTER (WHERE inside AND kind = 2) AS BIGINT) AS n_weekly FROM (SELECT *, lon BETWEEN -120 AND 60 AND lat BETWEEN -30 AND 40 AS inside FROM fx_stations)", T)
def stations_in_box(t):
    return coverage.stations_in_box(t("fx_stations"), -120, -30, 60, 40, 2)


@query("SELECT scene_id, place FROM fx_scenes WHERE scene_id IN (SELECT concat('S_', CAST(s_suppkey AS STRING), '_4001') FROM supplier WHERE s_suppkey % 7 = 0)", S)
def scene_semi(t):
    some = t("supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit("S_"), F.col("s_suppkey").cast("string"), F.lit("_4001")).alias("scene_id"))
    return t("fx_scenes").join(some, "scene_id", "left_semi").select("scene_id", "place")


@query(f"SELECT scene_id, round({area_sql('(lon - 0.15)', '(lat - 0.1)', '(lon + 0.15)', '(lat + 0.1)')}, 5) AS area_km2 FROM fx_scenes", S)
def box_area(t):
    return t("fx_scenes").select("scene_id", F.round(geo.box_area_km2(F.col("lon") - 0.15, F.col("lat") - 0.1, F.col("lon") + 0.15, F.col("lat") + 0.1), 5).alias("area_km2"))


def _utm() -> str:
    radius, forward, _ = geo._series()
    x = "eta + " + " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(forward, 1))
    y = "xi + " + " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(forward, 1))
    return f"""SELECT station, zone, round(500000 + {0.9996 * radius!r} * ({x}), 3) AS easting, round({0.9996 * radius!r} * ({y}), 3) AS northing FROM
 (SELECT station, zone, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM
 (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {geo.E!r} * atanh({geo.E!r} * sin(radians(lat)))) AS t FROM (SELECT *, CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 AS zone FROM fx_stations)))"""


@query(_utm(), T)
def utm_forward(t):
    zone = geo.utm_zone(F.col("lon"))
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), zone)
    return t("fx_stations").select("station", zone.alias("zone"), F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


def _projected() -> str:
    radius, forward, _ = geo._series()
    x = "eta + " + " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(forward, 1))
    y = "xi + " + " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(forward, 1))
    pole, rho = "CASE WHEN lat > 0 THEN 1 ELSE -1 END", f"{geo.polar_scale(32661)!r} * exp({geo.E!r} * atanh({geo.E!r} * sin(radians(abs(lat)))) - atanh(sin(radians(abs(lat)))))"
    return f"""SELECT station, epsg, round(CASE WHEN polar THEN 2000000 + {rho} * sin(radians(lon)) ELSE 500000 + {0.9996 * radius!r} * ({x}) END, 3) AS easting,
 round(CASE WHEN polar THEN 2000000 - {pole} * {rho} * cos(radians(lon)) ELSE CASE WHEN epsg > 32700 THEN 10000000 ELSE 0 END + {0.9996 * radius!r} * ({y}) END, 3) AS northing FROM
 (SELECT *, epsg IN (32661, 32761) AS polar, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM
 (SELECT *, radians(lon - (epsg % 100 * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {geo.E!r} * atanh({geo.E!r} * sin(radians(lat)))) AS t FROM
 (SELECT *, CAST(CASE WHEN lat > 84 THEN 32661 WHEN lat < -80 THEN 32761 ELSE CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 END AS INT) AS epsg FROM
 (SELECT station, lon, lat * 1.25 AS lat FROM fx_stations))))"""


@query(_projected(), T)
def projected(t):
    """Stations spread to 87 degrees of both hemispheres, each in the projection of its place."""
    spread = t("fx_stations").select("station", "lon", (F.col("lat") * 1.25).alias("lat"))
    placed = spread.withColumn("epsg", geo.epsg_for(F.col("lon"), F.col("lat")))
    x, y = geo.projected(F.col("lon"), F.col("lat"), F.col("epsg"))
    return placed.select("station", "epsg", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query("SELECT hypothesis, value FROM (SELECT concat('N', CAST(n_nationkey AS STRING), ' ', n_name) AS hypothesis, 'old' AS value FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT concat('N', CAST(r_regionkey AS STRING), ' ', r_name), 'new' FROM region)")
def verdict_upsert(t):
    tag = lambda key, name: F.concat(F.lit("N"), F.col(key).cast("string"), F.lit(" "), F.col(name)).alias("hypothesis")
    return ledger.upsert(t("nation").select(tag("n_nationkey", "n_name"), F.lit("old").alias("value")), t("region").select(tag("r_regionkey", "r_name"), F.lit("new").alias("value")))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS token FROM part")
def first_token(t):
    return t("part").select("p_partkey", token(F.col("p_name")).alias("token"))


@query("SELECT n_name AS name, CAST(n_nationkey AS INT) AS key FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS INT) FROM region")
def union_all(t):
    return t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")).unionByName(t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("SELECT n_name AS name, n_regionkey AS region, CAST(NULL AS STRING) AS label FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def union_missing_cols(t):
    return t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(t("region").select(F.col("r_name").alias("name"), F.lit("region").alias("label")), allowMissingColumns=True)


@query("SELECT CAST(n_regionkey AS STRING) AS kind, CAST(count(*) AS BIGINT) AS n, round(min(s_acctbal), 6) AS least, round(avg(s_acctbal), 6) AS mean FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def metrics_ledger(t):
    """A summary written as a JSON ledger and looked up again."""
    rows = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("string").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("least"), F.avg("s_acctbal").alias("mean"))
    path = f"{scratch(rows.sparkSession)}/metrics.json"
    ledger.write_metrics(rows, path, ["kind"])
    return tables.read_metrics(rows.sparkSession, path, ["kind"], "n bigint, least double, mean double").select("kind", "n", *rounded(6, "least", "mean"))


@query("SELECT 'r' || n_regionkey AS scene, 's' || (n_nationkey % 2) AS sensor, n_nationkey AS coarse_index, CASE WHEN n_nationkey % 5 > 0 THEN CAST(n_nationkey AS DOUBLE) / 8 END AS rrs_mean_560 FROM nation")
def frame_round_trip(t):
    """Aggregate frames written by scene and sensor and read again; NaN comes back as null."""
    k = F.col("n_nationkey")
    value = F.when(k % 5 > 0, k.cast("double") / 8).otherwise(F.lit(float("nan")))
    frame = t("nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("scene"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("sensor"), k.alias("coarse_index"), value.alias("rrs_mean_560"))
    path = f"{scratch(frame.sparkSession)}/frame"
    tables.write_aggregates(frame, path)
    return tables.aggregates(frame.sparkSession, path).select("scene", "sensor", "coarse_index", "rrs_mean_560")


@query("SELECT s_name || ', \"' || s_suppkey || '\"' AS station, CASE WHEN s_suppkey % 3 = 0 THEN 'weekly' ELSE 'cruise' END AS kind, round(s_acctbal / 200, 6) AS lat, CAST(s_suppkey AS DOUBLE) AS depth_m FROM supplier")
def station_file(t):
    """Stations from CSV with quoted commas and quotes."""
    rows = t("supplier").select(F.concat("s_name", F.lit(', "'), F.col("s_suppkey").cast("string"), F.lit('"')).alias("station"), F.when(F.col("s_suppkey") % 3 == 0, "weekly").otherwise("cruise").alias("kind"), (F.col("s_acctbal") / 200).alias("lat"), F.lit(0.0).alias("lon"), F.col("s_suppkey").cast("double").alias("depth_m"), F.lit("a, b").alias("sampling"), F.lit("x").alias("source"))
    path = f"{scratch(rows.sparkSession)}/stations"
    rows.write.csv(path, header=True, escape='"')
    return tables.stations(rows.sparkSession, path).where("sampling = 'a, b'").select("station", "kind", *rounded(6, "lat"), "depth_m")


@query("SELECT scene_id, '2024-01-01' AS date, place, round(lon - 0.15, 6) AS west, round(lat + 0.1, 6) AS north, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_scenes", S)
def scene_inventory(t):
    """Scenes from JSON, ids as strings, with the centres of their boxes."""
    box = F.array(F.col("lon") - 0.15, F.col("lat") - 0.1, F.col("lon") + 0.15, F.col("lat") + 0.1)
    rows = t("fx_scenes").select(F.col("scene_id").alias("id"), F.lit("2024-01-01").alias("dt"), box.alias("bbox"), F.col("place").alias("loc"))
    path = f"{scratch(rows.sparkSession)}/scenes"
    rows.write.json(path)
    return tables.inventory(rows.sparkSession, path, lines=True).select("scene_id", "date", "place", *rounded(6, "west", "north", "lon", "lat"))


@query("SELECT n_name AS scene, '2024_' || n_nationkey AS scene_id, '2024-01-02' AS date, CAST(n_nationkey AS DOUBLE) AS west, CAST(n_nationkey + 1 AS DOUBLE) AS east, 'a role of ' || n_regionkey AS role, 'http://x/2024_' || n_nationkey || '/2024_' || n_nationkey || '_b' AS url FROM nation WHERE n_nationkey < 20")
def scene_config(t):
    """Scenes of a configuration table, chosen by key, with the address of an asset."""
    rows = t("nation").orderBy("n_nationkey").collect()  # 25 rows: a configuration file
    config = {r["n_name"]: {"scene_id": f"2024_{r['n_nationkey']}", "date": "2024-01-02", "bbox": [r["n_nationkey"], 0, r["n_nationkey"] + 1, 1], "role": f" a  role\n of {r['n_regionkey']}"} for r in rows}
    chosen = tables.load_scenes(config, [r["n_name"] for r in rows if r["n_nationkey"] < 20])
    out = tables.scenes_frame(t("nation").sparkSession, chosen)
    urls = out.sparkSession.createDataFrame([(s.key, tables.asset_url("http://x/", s.scene_id, "b")) for s in chosen], "scene string, url string")
    return out.join(urls, "scene").select("scene", "scene_id", "date", "west", "east", "role", "url")
