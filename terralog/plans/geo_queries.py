"""Queries over fixes, poses, tiles and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog import dimensions
from terralog.functions import geodesy, localization, tiles
from terralog.functions.numeric import quantize
from terralog.functions.stamps import age_seconds
from terralog.operators import geo, joins, telemetry
from terralog.plans.registry import query, sql
from terralog.plans.views import Tables, whole

# SQL text of the shared formulas.
_PI = "pi()"
_RAD = "(least(greatest(lat, -85.05112878e0), 85.05112878e0) * pi() / 180e0)"


def _q(expression: str, scale: str = "1e4") -> str:
    return f"CAST(floor(({expression}) * {scale} + 0.5e0) AS BIGINT)"


def _tile_sql(zoom: int) -> str:
    n = f"{2 ** zoom}e0"
    return f"""
        SELECT *, (lon + 180e0) / 360e0 * {n} AS fx, (1e0 - ln(tan({_RAD}) + 1e0 / cos({_RAD})) / pi()) / 2e0 * {n} AS fy, {n} AS n,
               CAST(least(greatest(floor((lon + 180e0) / 360e0 * {n}), 0), {n} - 1) AS BIGINT) AS x,
               CAST(least(greatest(floor((1e0 - ln(tan({_RAD}) + 1e0 / cos({_RAD})) / pi()) / 2e0 * {n}), 0), {n} - 1) AS BIGINT) AS y
        FROM S_fix"""


@query("B23 B24 B25", sql(f"""
    SELECT seq, x, y, {_q('least(greatest((fx - x) * 256e0, 0e0), 256e0)', '1e3')} AS px, {_q('least(greatest((fy - y) * 256e0, 0e0), 256e0)', '1e3')} AS py,
           {_q('x / n * 360e0 - 180e0', '1e7')} AS west, {_q('degrees(atan(sinh(pi() * (1e0 - 2e0 * (y + 1) / n))))', '1e6')} AS south,
           {_q('(x + 1) / n * 360e0 - 180e0', '1e7')} AS east, {_q('degrees(atan(sinh(pi() * (1e0 - 2e0 * y / n))))', '1e6')} AS north,
           {_q('-pi() * 6378137e0 + x * (pi() * 6378137e0 * 2e0 / n)', '1e3')} AS min_x, {_q('pi() * 6378137e0 - y * (pi() * 6378137e0 * 2e0 / n)', '1e3')} AS max_y
    FROM ({_tile_sql(12)})""".replace("sinh(pi() * (1e0 - 2e0 * (y + 1) / n))", "(exp(pi() * (1e0 - 2e0 * (y + 1) / n)) - exp(-pi() * (1e0 - 2e0 * (y + 1) / n))) / 2e0").replace("sinh(pi() * (1e0 - 2e0 * y / n))", "(exp(pi() * (1e0 - 2e0 * y / n)) - exp(-pi() * (1e0 - 2e0 * y / n))) / 2e0"), "S_fix"))
def fix_tiles(t: Tables) -> DataFrame:
    rows = t.fixes().withColumn("key", tiles.tile_key(F.col("lat"), F.col("lon"), F.lit(12)))
    key = F.col("key")
    rows = rows.withColumns({
        "pixel": tiles.tile_pixel(F.col("lat"), F.col("lon"), key, F.lit(256)), "bounds": tiles.tile_bounds(key), "metres": tiles.tile_bounds_3857(key)
    })
    return rows.select(
        "seq", key["x"].cast("bigint").alias("x"), key["y"].cast("bigint").alias("y"), quantize(F.col("pixel.px"), 1e3).alias("px"), quantize(F.col("pixel.py"), 1e3).alias("py"),
        quantize(F.col("bounds.west"), 1e7).alias("west"), quantize(F.col("bounds.south"), 1e6).alias("south"), quantize(F.col("bounds.east"), 1e7).alias("east"),
        quantize(F.col("bounds.north"), 1e6).alias("north"), quantize(F.col("metres.min_x"), 1e3).alias("min_x"), quantize(F.col("metres.max_y"), 1e3).alias("max_y"),
    )


_CONTAINS = "lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END"
_BOXES = "(SELECT * FROM (VALUES " + ", ".join(f"('{r[1]}', {r[2]}e0, {r[3]}e0, {r[4]}e0, {r[5]}e0)" for r in dimensions.REGIONS) + ") b(region, south, west, north, east))"


@query("C6 B29", sql(f"SELECT seq FROM S_fix WHERE EXISTS (SELECT 1 FROM {_BOXES} WHERE {_CONTAINS})", "S_fix"))
def fixes_in_regions(t: Tables) -> DataFrame:
    return joins.in_region(t.fixes(), dimensions.load_dimensions(t.spark)["regions"]).select("seq")


@query("G3", sql(f"""
    SELECT seq, 0 + CASE WHEN inside AND p = 1 THEN 0 WHEN inside THEN 1 ELSE 0 END::BIGINT AS position, CASE p WHEN 1 THEN 'USGS 3DEP' ELSE 'Mapzen Terrain Tiles' END AS name
    FROM (SELECT seq, EXISTS (SELECT 1 FROM {_BOXES} WHERE {_CONTAINS}) AS inside FROM S_fix), (SELECT unnest([1, 2]) AS p) WHERE inside OR p = 2""", "S_fix"))
def elevation_candidates(t: Tables) -> DataFrame:
    return geo.dem_candidates(t.fixes()).select("seq", F.col("position").cast("bigint").alias("position"), "name")


@query("G4", sql("""
    SELECT request, arg_min(name, position) FILTER (WHERE success) AS loaded, array_to_string(list(name ORDER BY position), ', ') AS tried,
           CASE WHEN count(*) FILTER (WHERE success) = 0 THEN 'GeoTile fetch failed for ' || array_to_string(list(name ORDER BY position), ', ') || ': ' || arg_max(error, position) END AS error
    FROM S_attempt GROUP BY request""", "S_attempt"))
def loaded_tiles(t: Tables) -> DataFrame:
    return geo.first_success(t.attempts(), ["request"]).withColumn("tried", F.array_join("tried", ", "))


_REQUESTS = f"""
    SELECT f9.seq, 'satellite_imagery' AS kind, 'NASA GIBS' AS provider, 'MODIS_Terra_CorrectedReflectance_TrueColor' AS layer,
           strftime(CAST(make_timestamp(stamp_ns // 1000) AS DATE) - 2, '%Y-%m-%d') AS date, 9 AS z, x, y, 'jpg' AS extension FROM ({_tile_sql(9)}) f9
    UNION ALL SELECT seq, 'dem', 'Mapzen Terrain Tiles', 'terrarium', 'static', 12, x, y, 'png' FROM ({_tile_sql(12)})
    UNION ALL SELECT seq, 'dem', 'USGS 3DEP', '3DEPElevation', 'static', 12, x, y, 'tif' FROM ({_tile_sql(12)}) WHERE EXISTS (SELECT 1 FROM {_BOXES} WHERE {_CONTAINS})"""


@query("B26 B27 B28 B56", sql(f"""
    SELECT seq, provider, kind || '|' || provider || '|' || layer || '|' || date || '|' || z || '|' || x || '|' || y AS id,
           replace(provider, ' ', '_') || '/' || layer || '/' || date || '/' || z || '/' || x || '/' || y || '.' || extension AS path,
           CASE provider WHEN 'NASA GIBS' THEN 'https://gibs.earthdata.nasa.gov/wmts/epsg3857/best/MODIS_Terra_CorrectedReflectance_TrueColor/default/' || date || '/GoogleMapsCompatible_Level9/' || z || '/' || y || '/' || x || '.jpg'
             WHEN 'Mapzen Terrain Tiles' THEN 'https://s3.amazonaws.com/elevation-tiles-prod/terrarium/' || z || '/' || x || '/' || y || '.png' ELSE 'bbox' END AS source
    FROM ({_REQUESTS})""", "S_fix"))
def tile_requests(t: Tables) -> DataFrame:
    source = F.when(F.col("provider") == "USGS 3DEP", F.lit("bbox")).otherwise(F.col("source"))
    return geo.tile_requests(t.fixes()).select("seq", "provider", "id", "path", source.alias("source"))


@query("B25 B27", sql(f"""
    SELECT seq, printf('https://elevation.nationalmap.gov/arcgis/rest/services/3DEPElevation/ImageServer/exportImage?bbox=%.6f,%.6f,%.6f,%.6f&bboxSR=3857&imageSR=3857&size=256,256&format=tiff&pixelType=F32&interpolation=RSP_BilinearInterpolation&f=image',
           -20037508.342789244e0 + x * w, 20037508.342789244e0 - (y + 1) * w, -20037508.342789244e0 + (x + 1) * w, 20037508.342789244e0 - y * w) AS source
    FROM (SELECT *, 20037508.342789244e0 * 2e0 / n AS w FROM ({_tile_sql(12)})) WHERE EXISTS (SELECT 1 FROM {_BOXES} WHERE {_CONTAINS})""", "S_fix"))
def elevation_requests(t: Tables) -> DataFrame:
    return geo.tile_requests(t.fixes()).filter("provider = 'USGS 3DEP'").select("seq", "source")


@query("B56", sql(f"""
    SELECT seq, provider, CASE WHEN date <> 'static' THEN date END AS time, x AS tile_x, y AS tile_y, 256 AS tile_width, 'upper_left' AS pixel_origin,
           provider <> 'NASA GIBS' AS is_dem, CASE provider WHEN 'NASA GIBS' THEN 'wmts_jpeg' WHEN 'USGS 3DEP' THEN 'usgs_3dep_float32_tiff' ELSE 'terrarium_png' END AS encoding,
           to_base64(encode('tile ' || seq)) AS data FROM ({_REQUESTS})""", "S_fix"))
def tile_messages(t: Tables) -> DataFrame:
    requests = geo.tile_requests(t.fixes()).withColumn("bytes", F.concat(F.lit("tile "), F.col("seq").cast("string")).cast("binary"))
    return geo.tile_message(requests, "bytes").select(
        "seq", "provider", "time", F.col("tile_x").cast("bigint").alias("tile_x"), F.col("tile_y").cast("bigint").alias("tile_y"), "tile_width", "pixel_origin",
        (F.col("kind") == "dem").alias("is_dem"), "encoding", "data",
    )


@query("A12", sql(f"SELECT DISTINCT provider, layer, kind, date, z, x, y FROM ({_REQUESTS})".replace(" 9 AS z", " CAST(9 AS INTEGER) AS z"), "S_fix"))
def tile_records(t: Tables) -> DataFrame:
    return geo.tile_records(geo.tile_requests(t.fixes())).select("provider", "layer", "kind", "date", "z", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))


@query("C7", sql(f"""
    WITH R AS (SELECT * FROM ({_REQUESTS})), K AS (SELECT DISTINCT provider, date, x, y FROM R WHERE seq % 3 = 0)
    SELECT R.provider, count(*) AS wanted, count(*) FILTER (WHERE K.x IS NOT NULL) AS hits FROM R LEFT JOIN K USING (provider, date, x, y) GROUP BY ALL""", "S_fix"))
def tile_cache_hits(t: Tables) -> DataFrame:
    wanted = geo.tile_requests(t.fixes())
    cached = wanted.filter("seq % 3 = 0").select(*joins.TILE_KEY, F.col("path").alias("cache_path"))
    return joins.tile_hits(wanted, cached).groupBy("provider").agg(F.count("*").alias("wanted"), F.count_if("is_cached").alias("hits"))


@query("C7", sql(f"""
    WITH R AS (SELECT * FROM ({_REQUESTS}))
    SELECT DISTINCT provider, layer, date, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM R
    WHERE NOT EXISTS (SELECT 1 FROM R k WHERE k.seq % 3 = 0 AND k.provider = R.provider AND k.date = R.date AND k.x = R.x AND k.y = R.y)""", "S_fix"))
def tile_cache_misses(t: Tables) -> DataFrame:
    wanted = geo.tile_requests(t.fixes())
    return joins.tile_misses(wanted, wanted.filter("seq % 3 = 0"))


# --- as-of and georeference ----------------------------------------------------------------------------------------------


@query("C2", """
    SELECT c.event_id AS click, v.event_id AS view FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def latest_view_at_click(t: Tables) -> DataFrame:
    rows = t.table("events").select("user_id", "ts", "event_id", "event_type")
    clicks = rows.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    views = rows.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    return joins.asof_join(clicks, views, ["user_id"], "ts", "ts", ["view"], left_tie=["click"], right_tie=["view"]).select("click", "view")


_ECEF = """
    (6378137e0 / sqrt(1e0 - 6.69437999014e-3 * sin(radians({lat})) * sin(radians({lat}))) + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS {p}x,
    (6378137e0 / sqrt(1e0 - 6.69437999014e-3 * sin(radians({lat})) * sin(radians({lat}))) + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS {p}y,
    (6378137e0 / sqrt(1e0 - 6.69437999014e-3 * sin(radians({lat})) * sin(radians({lat}))) * (1e0 - 6.69437999014e-3) + {alt}) * sin(radians({lat})) AS {p}z"""


@query("B30 B33", sql(f"SELECT seq, {_q('ex', '1e2')} AS x, {_q('ey', '1e2')} AS y, {_q('ez', '1e2')} AS z FROM (SELECT seq, {_ECEF.format(lat='lat', lon='lon', alt='alt', p='e')} FROM S_fix)", "S_fix"))
def earth_centred(t: Tables) -> DataFrame:
    usable = t.fixes().filter(geodesy.usable_fix(F.col("lat"), F.col("lon"), F.col("alt")))
    rows = usable.select("seq", geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt")).alias("e"))
    return rows.select("seq", *[quantize(F.col(f"e.{c}"), 1e2).alias(c) for c in "xyz"])


_WITH_POSE = """
    SELECT f.*, p.stamp_ns AS pose_ns, p.x AS mx, p.y AS my, p.z AS mz FROM S_fix f
    ASOF LEFT JOIN S_pose p ON f.session_id = p.session_id AND f.stamp_ns >= p.stamp_ns"""
_ORIGIN = f"""
    SELECT session_id, min(stamp_ns) AS origin_ns, arg_min(lat, stamp_ns) AS olat, arg_min(lon, stamp_ns) AS olon, arg_min(alt, stamp_ns) AS oalt,
           arg_min(mx, stamp_ns) AS omx, arg_min(my, stamp_ns) AS omy, arg_min(mz, stamp_ns) AS omz
    FROM ({_WITH_POSE}) WHERE hacc BETWEEN 0 AND 25 AND pose_ns IS NOT NULL GROUP BY session_id"""
_PLACED = f"""
    SELECT session_id, seq, stamp_ns, coalesce(stamp_ns >= origin_ns, false) AS established, pose_ns,
           -sin(radians(olon)) * (ex - ox) + cos(radians(olon)) * (ey - oy) AS e,
           -sin(radians(olat)) * cos(radians(olon)) * (ex - ox) - sin(radians(olat)) * sin(radians(olon)) * (ey - oy) + cos(radians(olat)) * (ez - oz) AS n,
           cos(radians(olat)) * cos(radians(olon)) * (ex - ox) + cos(radians(olat)) * sin(radians(olon)) * (ey - oy) + sin(radians(olat)) * (ez - oz) AS u,
           omx, omy, omz
    FROM (SELECT *, {_ECEF.format(lat='lat', lon='lon', alt='alt', p='e')}, {_ECEF.format(lat='olat', lon='olon', alt='oalt', p='o')}
          FROM ({_WITH_POSE}) LEFT JOIN ({_ORIGIN}) USING (session_id))"""


@query("E6", sql(f"SELECT session_id, origin_ns, {_q('olat')} AS lat, {_q('omx')} AS mx FROM ({_ORIGIN})", "S_fix", "S_pose"))
def session_origins(t: Tables) -> DataFrame:
    origins = geo.first_origin(geo.with_pose(t.fixes(), t.poses()))
    o = F.col("origin")
    return origins.select("session_id", o["stamp_ns"].alias("origin_ns"), quantize(o["lat"]).alias("lat"), quantize(o["mx"]).alias("mx"))


@query("C3 B31", sql(f"""
    SELECT session_id, seq, established,
           CASE WHEN established THEN NULL WHEN pose_ns IS NULL THEN 'waiting_for_arkit_map_pose' ELSE 'waiting_for_accurate_gps_origin' END AS reason,
           CASE WHEN established THEN {_q('omx + e', '10')} END AS x, CASE WHEN established THEN {_q('omy + u', '10')} END AS y, CASE WHEN established THEN {_q('omz - n', '10')} END AS z,
           CASE WHEN established THEN {_q('e', '10')} END AS e, CASE WHEN established THEN {_q('n', '10')} END AS n, CASE WHEN established THEN {_q('u', '10')} END AS u
    FROM ({_PLACED})""", "S_fix", "S_pose"))
def georeferenced_fixes(t: Tables) -> DataFrame:
    placed = geo.georeference(t.fixes(), t.poses())
    return placed.select("session_id", "seq", "established", "reason", *[quantize(F.col(f"map.{c}"), 10.0).alias(c) for c in "xyz"], *[quantize(F.col(f"enu.{c}"), 10.0).alias(c) for c in "enu"])


@query("J6", sql(f"""
    SELECT a.session_id, count(*) AS fixes, {_q('avg(sqrt(pow(omx + e - p.x, 2) + pow(omy + u - p.y, 2) + pow(omz - n - p.z, 2)))', '10')} AS mean_m,
           {_q('quantile_disc(sqrt(pow(omx + e - p.x, 2) + pow(omy + u - p.y, 2) + pow(omz - n - p.z, 2)), 0.95)', '10')} AS p95_m FROM ({_PLACED}) a ASOF JOIN S_pose p ON a.session_id = p.session_id AND a.stamp_ns >= p.stamp_ns WHERE established GROUP BY a.session_id""", "S_fix", "S_pose"))
def alignment_residuals(t: Tables) -> DataFrame:
    return geo.alignment_residuals(t.fixes(), t.poses()).select("session_id", "fixes", *[quantize(F.col(c), 10.0).alias(c) for c in ("mean_m", "p95_m")])


@query("B32 B51", sql(f"""
    SELECT p.session_id, count(*) AS poses, 3 * count(*) + count(*) FILTER (WHERE p.stamp_ns >= origin_ns) AS edges,
           count(*) FILTER (WHERE p.stamp_ns >= origin_ns) AS earth_edges, {_q('sum(p.x)', '1e2')} AS odom_tx, {_q('sum(p.y)', '1e2')} AS odom_ty, {_q('sum(p.z)', '1e2')} AS odom_tz,
           {_q('sum(p.qy)', '1e3')} AS odom_qy, {_q('sum(p.qw)', '1e3')} AS odom_qw
    FROM S_pose p LEFT JOIN ({_ORIGIN}) o ON p.session_id = o.session_id GROUP BY p.session_id""", "S_fix", "S_pose"))
def frame_edges(t: Tables) -> DataFrame:
    origins = geo.first_origin(geo.with_pose(t.fixes(), t.poses()))
    edges = geo.tf_rows(t.poses(), origins)
    earth = F.col("parent") == "earth"
    sums = [quantize(F.sum(F.when(F.col("child") == "base_link", F.col(c))), s).alias(f"odom_{c}") for c, s in (("tx", 1e2), ("ty", 1e2), ("tz", 1e2), ("qy", 1e3), ("qw", 1e3))]
    return edges.groupBy("session_id").agg(F.count_if(F.col("child") == "odom").alias("poses"), F.count("*").alias("edges"), F.count_if(earth).alias("earth_edges"), *sums)


@query("B32", sql(f"""
    SELECT session_id, {_q('ox - (-sin(radians(olon)) * omx + cos(radians(olat)) * cos(radians(olon)) * omy + sin(radians(olat)) * cos(radians(olon)) * omz)', '1e2')} AS tx,
           {_q('oy - (cos(radians(olon)) * omx + cos(radians(olat)) * sin(radians(olon)) * omy + sin(radians(olat)) * sin(radians(olon)) * omz)', '1e2')} AS ty,
           {_q('oz - (sin(radians(olat)) * omy - cos(radians(olat)) * omz)', '1e2')} AS tz,
           {_q('-sin(radians(olon))', '1e3')} AS r00, {_q('cos(radians(olon))', '1e3')} AS r10, CAST(0 AS BIGINT) AS r20,
           {_q('sin(radians(olat)) * cos(radians(olon))', '1e3')} AS r02, {_q('sin(radians(olat)) * sin(radians(olon))', '1e3')} AS r12, {_q('-cos(radians(olat))', '1e3')} AS r22
    FROM (SELECT *, {_ECEF.format(lat='olat', lon='olon', alt='oalt', p='o')} FROM ({_ORIGIN}))""", "S_fix", "S_pose"))
def earth_to_map_frames(t: Tables) -> DataFrame:
    o = F.col("origin")
    origins = geo.first_origin(geo.with_pose(t.fixes(), t.poses()))
    at = F.struct(o["mx"].alias("x"), o["my"].alias("y"), o["mz"].alias("z"))
    frame = geodesy.earth_to_map(o["lat"], o["lon"], geodesy.to_ecef(o["lat"], o["lon"], o["alt"]), at)
    x, y, z, w = (F.col(f"f.rotation.q{c}") for c in "xyzw")
    # two axes that the rotation gives, which hold all of it
    axes = {
        "r00": 1 - 2 * (y * y + z * z), "r10": 2 * (x * y + z * w), "r20": 2 * (x * z - y * w),
        "r02": 2 * (x * z + y * w), "r12": 2 * (y * z - x * w), "r22": 1 - 2 * (x * x + y * y),
    }
    return origins.withColumn("f", frame).select(
        "session_id", *[quantize(F.col(f"f.{c}"), 1e2).alias(c) for c in ("tx", "ty", "tz")], *[quantize(v, 1e3).alias(n) for n, v in axes.items()]
    )


@query("E5", sql(f"""
    SELECT session_id, seq, CASE WHEN dt > 1e-4 THEN {_q("(2e0 * c * c - 1e0) * (x - bx) / dt - 2e0 * s * c * (z - bz) / dt", "1e4")} ELSE 0 END AS vx,
           CASE WHEN dt > 1e-4 THEN {_q("(y - by_) / dt", "1e4")} ELSE 0 END AS vy,
           CASE WHEN dt > 1e-4 THEN {_q("2e0 * s * c * (x - bx) / dt + (2e0 * c * c - 1e0) * (z - bz) / dt", "1e4")} ELSE 0 END AS vz, CAST(0 AS BIGINT) AS wx, CAST(0 AS BIGINT) AS wz,
           CASE WHEN dt > 1e-4 THEN {_q("(CASE WHEN turn > pi() THEN turn - 2e0 * pi() ELSE turn END) * CASE WHEN side > 0 THEN 1e0 WHEN side < 0 THEN -1e0 ELSE 0e0 END / dt", "1e3")} ELSE 0 END AS wy
    FROM (SELECT *, 2e0 * acos(least(1e0, greatest(-1e0, c * bc + s * bs))) AS turn, CASE WHEN abs(s * bc - c * bs) < 1e-7 THEN 0e0 ELSE s * bc - c * bs END AS side
          FROM (SELECT session_id, seq, x, y, z, qy AS s, qw AS c, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(z) OVER w AS bz, lag(qy) OVER w AS bs, lag(qw) OVER w AS bc,
                       (stamp_ns - lag(stamp_ns) OVER w) / 1e9 AS dt
                FROM S_pose WINDOW w AS (PARTITION BY session_id ORDER BY stamp_ns, seq)))""", "S_pose"))
def odometry_twists(t: Tables) -> DataFrame:
    rows = geo.odometry_twist(t.poses())
    return rows.select("session_id", "seq", quantize(F.col("vx"), 1e4).alias("vx"), quantize(F.col("vy"), 1e4).alias("vy"), quantize(F.col("vz"), 1e4).alias("vz"), *[quantize(F.col(c), 1e3).alias(c) for c in ("wx", "wy", "wz")])


# --- fixes ---------------------------------------------------------------------------------------------------------------


@query("B10", sql(f"""
    SELECT seq, true AS has_fix, 0 AS status, 1 AS service, {_q('hacc * hacc')} AS h_var, {_q('CASE WHEN vacc >= 0 THEN vacc * vacc ELSE hacc * hacc END')} AS v_var,
           CASE WHEN vacc >= 0 THEN 2 ELSE 1 END AS covariance_type FROM S_fix""", "S_fix"))
def navsat_messages(t: Tables) -> DataFrame:
    c = F.col
    rows = t.fixes().withColumn("m", localization.navsat_fix(c("lat"), c("lon"), c("alt"), c("hacc"), c("vacc")))
    covariance = c("m.position_covariance")
    return rows.select(
        "seq", "m.has_fix", "m.status", "m.service", quantize(covariance[0]).alias("h_var"), quantize(covariance[8]).alias("v_var"), c("m.position_covariance_type").alias("covariance_type")
    )


@query("B11", sql("""
    SELECT seq, true AS coordinate, true AS altitude, hacc >= 0 AS horizontal_accuracy, vacc >= 0 AS vertical_accuracy, seq % 7 <> 0 AS speed, seq % 3 = 0 AS speed_accuracy, false AS course, false AS course_accuracy,
           CAST(floor(abs(1700001000000000000 - stamp_ns) / 1e9 + 0.5e0) AS BIGINT) AS age FROM S_fix""", "S_fix"))
def fix_flags(t: Tables) -> DataFrame:
    c = F.col
    speed = F.when(c("seq") % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5))
    flags = localization.fix_validity(c("lat"), c("lon"), c("alt"), horizontal_accuracy=c("hacc"), vertical_accuracy=c("vacc"), speed=speed, speed_accuracy=F.when(c("seq") % 3 == 0, F.lit(0.5)), course=F.lit(-1.0))
    return t.fixes().withColumn("f", flags).select(
        "seq", "f.*", whole(age_seconds(F.lit(1_700_001_000_000_000_000), c("stamp_ns"))).alias("age")
    )


def _ramp(value: str, good: str, bad: str) -> str:
    return f"CASE WHEN {value} < 0 THEN 0e0 WHEN {value} <= {good} THEN 1e0 WHEN {value} >= {bad} THEN 0e0 ELSE 1e0 - ({value} - {good}) / ({bad} - {good}) END"


_SOURCE = "CASE WHEN seq % 11 = 0 THEN 0.2e0 WHEN seq % 5 = 0 THEN 0.8e0 ELSE 1e0 END"
_AGE = "(seq % 14)"
_HEADING = "(seq % 70)"
_SCORES = f"""
    SELECT seq, ({_ramp('hacc', '3e0', '25e0')}) * 0.38e0 + CASE WHEN seq % 4 = 0 THEN 1e0 ELSE 0.35e0 END * 0.24e0
                + CASE WHEN seq % 3 = 0 THEN 0.25e0 ELSE {_ramp(_HEADING, '8e0', '60e0')} END * 0.18e0
                + CASE WHEN {_AGE} <= 1 THEN 1e0 WHEN {_AGE} >= 10 THEN 0e0 ELSE 1e0 - ({_AGE} - 1e0) / 9e0 END * 0.1e0 + {_SOURCE} * 0.1e0 AS indoor,
           ({_ramp('hacc', '5e0', '60e0')}) * 0.34e0 + ({_ramp('vacc', '8e0', '80e0')}) * 0.2e0
                + CASE WHEN seq % 3 = 0 THEN 0.3e0 ELSE {_ramp(_HEADING, '10e0', '90e0')} END * 0.16e0 + 0.2e0 + {_SOURCE} * 0.1e0 AS world
    FROM S_fix"""


def _label(score: str) -> str:
    return f"CASE WHEN {score} >= 0.8e0 THEN 'high' WHEN {score} >= 0.5e0 THEN 'medium' WHEN {score} >= 0.25e0 THEN 'low' ELSE 'unusable' END"


def scored_fixes(t: Tables) -> DataFrame:
    s = F.col("seq")
    rows = t.fixes().withColumns({
        "floor": F.when(s % 4 == 0, F.lit(2)), "heading_acc": F.when(s % 3 != 0, (s % 70).cast("double")), "age_s": (s % 14).cast("double"),
        "simulated": s % 11 == 0, "accessory": s % 5 == 0,
    })
    return telemetry.localization_scores(rows)


@query("B34 B35", sql(f"""
    SELECT seq, {_q('least(greatest(indoor, 0e0), 1e0)', '1e6')} AS indoor, {_q('least(greatest(world, 0e0), 1e0)', '1e6')} AS world,
           {_label('indoor')} AS indoor_label, {_label('world')} AS world_label FROM ({_SCORES})""", "S_fix"))
def localization_quality(t: Tables) -> DataFrame:
    rows = scored_fixes(t)
    return rows.select("seq", quantize(F.col("indoor_quality"), 1e6).alias("indoor"), quantize(F.col("global_quality"), 1e6).alias("world"), "indoor_label", F.col("global_label").alias("world_label"))


@query("B15", """
    SELECT event_id AS seq, CAST(floor(value * 1e2 + 0.5e0) AS BIGINT) AS x, CAST(floor(sin((event_id % 50) * 0.06e0 / 2e0) * 1e6 + 0.5e0) AS BIGINT) AS qy,
           CAST(floor(cos((event_id % 50) * 0.06e0 / 2e0) * 1e6 + 0.5e0) AS BIGINT) AS qw FROM events""")
def poses_from_matrices(t: Tables) -> DataFrame:
    angle = (F.col("event_id") % 50) * F.lit(0.06)
    s, c, zero, one = F.sin(angle), F.cos(angle), F.lit(0.0), F.lit(1.0)
    matrix = F.array(c, zero, s, F.col("value"), zero, one, zero, zero, -s, zero, c, zero, zero, zero, zero, one)
    rows = t.table("events").select(F.col("event_id").alias("seq"), geodesy.pose_from_matrix(matrix).alias("p"))
    return rows.select("seq", quantize(F.col("p.x"), 1e2).alias("x"), quantize(F.col("p.rotation.qy"), 1e6).alias("qy"), quantize(F.col("p.rotation.qw"), 1e6).alias("qw"))


@query("B50", sql("SELECT seq, CAST(floor((x + 0.5e0) * 9.81e0 * 1e4 + 0.5e0) AS BIGINT) AS ax, CAST(floor((z - 1e0) * 9.81e0 * 1e4 + 0.5e0) AS BIGINT) AS az FROM S_pose", "S_pose"))
def accelerations(t: Tables) -> DataFrame:
    rows = t.poses().select("seq", *[F.col(c).alias(f"user_{c}") for c in "xyz"], F.lit(0.5).alias("gravity_x"), F.lit(0.0).alias("gravity_y"), F.lit(-1.0).alias("gravity_z"))
    return telemetry.imu_rows(rows).select("seq", quantize(F.col("ax")).alias("ax"), quantize(F.col("az")).alias("az"))


@query("E13", sql("""
    SELECT session_id, seq, coalesce(stamp_ns - lag(stamp_ns) OVER w > 30000000000, false) AS stale, (stamp_ns - lag(stamp_ns) OVER w) // 1000000000 AS gap
    FROM S_fix WINDOW w AS (PARTITION BY session_id ORDER BY stamp_ns, seq)""", "S_fix"))
def stale_fixes(t: Tables) -> DataFrame:
    rows = telemetry.staleness(t.fixes(), ["session_id"], "stamp_ns", "seq", 30.0)
    return rows.select("session_id", "seq", "stale", F.floor("gap_s").alias("gap"))
