"""Queries over points, depth grids and surfels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions import camera
from terralog.functions.numeric import quantize, whole_div
from terralog.operators import calibration, joins, payloads, points
from terralog.operators.mesh import surfel_triangles
from terralog.plans.registry import query, sql
from terralog.plans.views import Tables
from terralog.sources import artifacts


def _q(expression: str, scale: str = "1e4") -> str:
    return f"CAST(floor(({expression}) * {scale} + 0.5e0) AS BIGINT)"


def _near(value: Column, scale: float) -> Column:
    """Like ``quantize``, but cut where means of whole numbers do not fall."""
    return F.floor(value * F.lit(scale) + F.lit(0.371931)).cast("bigint")


def _qn(expression: str, scale: str = "1e4") -> str:
    return f"CAST(floor(({expression}) * {scale} + 0.371931e0) AS BIGINT)"


# --- cells ---------------------------------------------------------------------------------------------------------------

_CELL = "CAST(floor(x / {s}) AS BIGINT) AS vx, CAST(floor(y / {s}) AS BIGINT) AS vy, CAST(floor(z / {s}) AS BIGINT) AS vz"


@query("D6", sql(f"SELECT session_id, vx, vy, vz, arg_min(frame, (frame, seq)) AS frame, arg_min(seq, (frame, seq)) AS seq FROM (SELECT *, {_CELL.format(s='0.5e0')} FROM S_point) GROUP BY ALL", "S_point"))
def thinned_points(t: Tables) -> DataFrame:
    return points.voxel_filter(t.points(), 0.5, ["frame", "seq"], ["session_id"]).select("session_id", "vx", "vy", "vz", "frame", "seq")


@query("D7", sql(f"SELECT vx, vy, vz, count(*) AS points FROM (SELECT {_CELL.format(s='0.2e0')} FROM S_point) GROUP BY ALL", "S_point"))
def voxel_counts(t: Tables) -> DataFrame:
    return points.voxel_counts(t.points(), 0.2)


_COUNTS = f"(SELECT vx, vy, vz, count(*) AS points FROM (SELECT {_CELL.format(s='0.2e0')} FROM S_point {{where}}) GROUP BY ALL)"
_STEPS = "(SELECT a.s AS dx, b.s AS dy, c.s AS dz FROM (SELECT unnest([-1, 0, 1]) AS s) a, (SELECT unnest([-1, 0, 1]) AS s) b, (SELECT unnest([-1, 0, 1]) AS s) c)"
_NEIGHBORS = f"""
    SELECT n.vx + dx AS vx, n.vy + dy AS vy, n.vz + dz AS vz, CAST(sum(n.points) AS BIGINT) AS neighbors FROM {_COUNTS} n, {_STEPS} GROUP BY ALL"""


@query("C8", sql(f"SELECT s.vx, s.vy, s.vz, neighbors FROM ({_NEIGHBORS.format(where='')}) s JOIN {_COUNTS.format(where='')} c USING (vx, vy, vz)", "S_point"))
def neighbor_counts(t: Tables) -> DataFrame:
    return points.neighbor_counts(points.voxel_counts(t.points(), 0.2))


_NEAR = "WHERE sqrt(x * x + y * y + z * z) < 5e0"


@query("D11", sql(f"""
    SELECT p.session_id, p.frame, p.seq FROM (SELECT *, {_CELL.format(s='0.2e0')} FROM S_point {_NEAR}) p
    JOIN ({_NEIGHBORS.format(where=_NEAR)}) n USING (vx, vy, vz) WHERE neighbors > 400""", "S_point"))
def inlier_points(t: Tables) -> DataFrame:
    return points.remove_outliers(t.points(), 5.0, 0.2, 400).select("session_id", "frame", "seq")


# --- depth ---------------------------------------------------------------------------------------------------------------


def _pairs(t: Tables) -> DataFrame:
    return t.depth().withColumnsRenamed({"px": "lx", "py": "ly"})


_FIT_SAMPLES = """
    SELECT frame, relative AS x, depth AS y, CASE confidence WHEN 0 THEN 0.2e0 WHEN 1 THEN 0.65e0 ELSE 1e0 END
           / (greatest(0.015e0, 0.012e0 + 0.004e0 * depth * depth) * greatest(0.015e0, 0.012e0 + 0.004e0 * depth * depth)) AS w
    FROM S_depth WHERE px % 4 = 0 AND py % 4 = 0 AND depth > 0.2e0 AND depth < 5e0 AND relative > 0"""


def _fit(weight: str) -> str:
    return f"""
    SELECT frame, samples, CASE WHEN samples > 50 AND abs(d) > 1e-6 THEN CAST(floor((sw * sxy - sx * sy) / d * 1e6 + 0.371931e0) AS BIGINT) END AS scale,
           CASE WHEN samples > 50 AND abs(d) > 1e-6 THEN CAST(floor((sy * sxx - sx * sxy) / d * 1e6 + 0.371931e0) AS BIGINT) END AS offset_
    FROM (SELECT *, sw * sxx - sx * sx AS d FROM (SELECT frame, count(*) AS samples, sum({weight}) AS sw, sum({weight} * x) AS sx, sum({weight} * y) AS sy, sum({weight} * x * x) AS sxx, sum({weight} * x * y) AS sxy
          FROM ({_FIT_SAMPLES}) GROUP BY frame))"""


@query("D8", sql(_fit("w"), "S_depth"))
def weighted_calibrations(t: Tables) -> DataFrame:
    return calibration.fit_calibration(_pairs(t)).select("frame", "samples", _near(F.col("scale"), 1e6).alias("scale"), _near(F.col("offset"), 1e6).alias("offset_"))


@query("D9", sql(_fit("1e0"), "S_depth"))
def affine_fits(t: Tables) -> DataFrame:
    return calibration.fit_affine(_pairs(t)).select("frame", "samples", _near(F.col("scale"), 1e6).alias("scale"), _near(F.col("offset"), 1e6).alias("offset_"))


@query("C5", sql("""
    SELECT a.frame, a.px, a.py, b.px AS qx, b.py AS qy FROM S_depth a JOIN S_depth b
    ON a.frame = b.frame AND b.px = CAST(trunc(a.px / 31e0 * 15e0) AS BIGINT) AND b.py = CAST(trunc(a.py / 31e0 * 11e0) AS BIGINT)""", "S_depth"))
def nearest_samples(t: Tables) -> DataFrame:
    """Cells of the 32 x 32 grid with their places on a 16 x 12 grid."""
    grid = t.depth().filter("px < 16 and py < 12").select("frame", F.col("px").cast("int").alias("qx"), F.col("py").cast("int").alias("qy"))
    cells = t.depth().select("frame", "px", "py")
    size, other = F.lit(32), (F.lit(16), F.lit(12))
    return joins.nearest_sample(cells, grid, ("px", "py"), ("qx", "qy"), (size, size), other).select(
        "frame", "px", "py", F.col("qx").cast("bigint").alias("qx"), F.col("qy").cast("bigint").alias("qy")
    )


@query("B16 B17", sql(f"""
    SELECT frame, px, py, CASE WHEN 1.5e0 * relative - 0.4e0 > 0.1e0 THEN {_q('1.5e0 * relative - 0.4e0', '1e5')} END AS metric, {_q('1.5e0 * relative - 0.4e0', '1e5')} AS affine FROM S_depth""", "S_depth"))
def metric_depths(t: Tables) -> DataFrame:
    a, b, r = F.lit(1.5), F.lit(-0.4), F.col("relative")
    return t.depth().select("frame", "px", "py", quantize(camera.calibrated_depth(r, a, b), 1e5).alias("metric"), quantize(camera.affine_depth(r, a, b), 1e5).alias("affine"))


# the camera of ``Tables.intrinsics``: 600, 590, 320, 240 at 640 x 480 scaled to 32 x 32; map = (z + frame, y + 2, 3 - x)
_SX, _SY = "(32e0 / 640)", "(32e0 / 480)"
_X = f"(px - 320e0 * {_SX}) / (600e0 * {_SX}) * d"
_Y = f"(240e0 * {_SY} - py) / (590e0 * {_SY}) * d"


def _cloud_sql(d: str, where: str, in_map: bool) -> str:
    x, y, z = ("-d + frame", f"{_Y} + 2e0", f"3e0 - ({_X})") if in_map else (_X, _Y, "-d")
    return f"SELECT frame, px, py, {_qn(x, '1e5')} AS x, {_qn(y, '1e5')} AS y, {_qn(z, '1e5')} AS z FROM (SELECT *, {d} AS d FROM S_depth) WHERE {where}"


def _shown(cloud: DataFrame) -> DataFrame:
    return cloud.select("frame", "px", "py", *[_near(F.col(c), 1e5).alias(c) for c in "xyz"])


@query("B18 B19 B20", sql(_cloud_sql("depth", "px % 4 = 0 AND py % 4 = 0 AND d > 0.1e0 AND d < 5e0", True), "S_depth"))
def lidar_points(t: Tables) -> DataFrame:
    return _shown(points.lidar_cloud(t.depth(), t.intrinsics()))


@query("B21", sql(_cloud_sql("depth", "d > 0.1e0", True), "S_depth"))
def dense_points(t: Tables) -> DataFrame:
    return _shown(points.dense_cloud(t.depth(), t.intrinsics()))


@query("B22", sql(_cloud_sql("relative", "d > 1e-6 AND d < 1e4", False), "S_depth"))
def relative_points(t: Tables) -> DataFrame:
    return _shown(points.relative_cloud(t.depth(), t.intrinsics()))


@query("B22b", sql(f"""
    WITH fit AS ({_fit('w').replace('CAST(floor((sw * sxy - sx * sy) / d * 1e6 + 0.371931e0) AS BIGINT)', '(sw * sxy - sx * sy) / d').replace('CAST(floor((sy * sxx - sx * sxy) / d * 1e6 + 0.371931e0) AS BIGINT)', '(sy * sxx - sx * sxy) / d')})
    SELECT frame, count(*) AS points, {_qn('sum(d) / count(*)', '1e5')} AS mean_depth FROM (SELECT frame, scale * relative + offset_ AS d FROM S_depth JOIN fit USING (frame)) WHERE d > 0.1e0 GROUP BY frame""", "S_depth"))
def fused_points(t: Tables) -> DataFrame:
    """Relative depth made metric by the fit of its own frame."""
    fits = calibration.fit_calibration(_pairs(t))
    cloud = points.calibrated_cloud(t.depth(), t.intrinsics(), fits)
    return cloud.groupBy("frame").agg(F.count("*").alias("points"), _near(F.sum("depth") / F.count("*"), 1e5).alias("mean_depth"))


@query("B14", """
    SELECT event_id AS seq, CAST(trunc(greatest(0e0, least(255e0, y + 1.402e0 * v))) AS BIGINT) AS r, CAST(trunc(greatest(0e0, least(255e0, y - 0.344136e0 * u - 0.714136e0 * v))) AS BIGINT) AS g,
           CAST(trunc(greatest(0e0, least(255e0, y + 1.772e0 * u))) AS BIGINT) AS b
    FROM (SELECT event_id, event_id % 256 AS y, (event_id * 7 % 256) - 128e0 AS u, (event_id * 13 % 256) - 128e0 AS v FROM events)""")
def converted_colours(t: Tables) -> DataFrame:
    """Colours through packing and unpacking."""
    e = F.col("event_id")
    rows = t.table("events").select(e.alias("seq"), camera.ycbcr_to_rgb(e % 256, e * 7 % 256, e * 13 % 256).alias("c"))
    rows = rows.select("seq", camera.unpack_rgb(camera.pack_rgb(F.col("c.r"), F.col("c.g"), F.col("c.b"))).alias("c"))
    return rows.select("seq", *[F.col(f"c.{x}").cast("bigint").alias(x) for x in "rgb"])


@query("B12 B13", """
    SELECT o_orderkey AS seq, o_custkey || ',0,' || o_orderkey % 640 || ',0,590,' || o_orderkey % 480 || ',0,0,1' AS k, '1,0,0,0,1,0,0,0,1' AS r,
           o_custkey || ',0,' || o_orderkey % 640 || ',0,0,590,' || o_orderkey % 480 || ',0,0,0,1,0' AS p, '0,0,0,0,0' AS d,
           array_to_string(list_transform(range(36), lambda i: CASE i WHEN 0 THEN 25 WHEN 7 THEN o_orderkey % 9 * 25 WHEN 14 THEN 25 WHEN 21 THEN 4 WHEN 28 THEN 4 WHEN 35 THEN 4 ELSE 0 END), ',') AS covariance
    FROM orders""")
def camera_messages(t: Tables) -> DataFrame:
    c = F.col
    rows = t.table("orders").select(
        c("o_orderkey").alias("seq"),
        camera.camera_matrices(c("o_custkey").cast("double"), F.lit(590.0), (c("o_orderkey") % 640).cast("double"), (c("o_orderkey") % 480).cast("double")).alias("m"),
        camera.diag_covariance(0.0025, (c("o_orderkey") % 9) / F.lit(400.0), *camera.POSE_DIAGONAL[2:]).alias("v"),
    )
    text = {x: F.array_join(c(f"m.{x}").cast("array<bigint>").cast("array<string>"), ",").alias(x) for x in "krpd"}
    return rows.select("seq", *text.values(), F.array_join(F.transform("v", lambda x: quantize(x).cast("string")), ",").alias("covariance"))


_FIT_RAW = _fit("w").replace("CAST(floor((sw * sxy - sx * sy) / d * 1e6 + 0.371931e0) AS BIGINT)", "(sw * sxy - sx * sy) / d")


@query("E7", sql(f"""
    WITH RECURSIVE frames AS MATERIALIZED (SELECT frame % 3 AS session_id, frame, scale, row_number() OVER (PARTITION BY frame % 3 ORDER BY frame) AS k FROM ({_FIT_RAW})),
    chain AS (
        SELECT session_id, k, frame, false AS reused, scale AS used, CASE WHEN scale IS NOT NULL THEN frame END AS entry, scale AS held FROM frames WHERE k = 1
        UNION ALL
        SELECT session_id, k, frame, reused, CASE WHEN reused THEN held ELSE scale END, CASE WHEN reused OR scale IS NULL THEN entry ELSE frame END, CASE WHEN reused OR scale IS NULL THEN held ELSE scale END
        FROM (SELECT f.*, c.entry, c.held, coalesce((f.frame - c.entry) * 0.4e0 <= 1.25e0 AND (f.frame - c.entry) * 0.03e0 <= 0.2e0, false) AS reused
              FROM chain c JOIN frames f ON f.session_id = c.session_id AND f.k = c.k + 1))
    SELECT session_id, frame, reused, {_qn('used', '1e6')} AS scale FROM chain""", "S_depth"))
def reused_calibrations(t: Tables) -> DataFrame:
    """One calibration per depth frame, frames 0.4 s apart per session, camera moving a little."""
    fits = calibration.fit_calibration(_pairs(t))
    f = F.col("frame")
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(one, zero, zero, f * F.lit(0.03), zero, one, zero, zero, zero, zero, one, zero, zero, zero, zero, one)
    frames = fits.select(
        (f % 3).alias("session_id"), "frame", (f * 400_000_000).alias("stamp_ns"), "scale", "offset", m.alias("m"),
        *[F.lit(32).alias(n) for n in ("relative_w", "relative_h", "lidar_w", "lidar_h", "confidence_w", "confidence_h")],
    )
    return calibration.reuse_calibration(frames).select("session_id", "frame", "reused", _near(F.col("scale"), 1e6).alias("scale"))


# --- surfels -------------------------------------------------------------------------------------------------------------

_FUSED = f"""
    SELECT session_id, vx, vy, vz, count(*) AS observation_count, max(stamp_ns) AS updated_at, least(1e0, 0.2e0 + 0.04e0 * (count(*) - 1)) AS confidence,
           {', '.join(f"CASE WHEN count(*) <= 65 THEN sum({c}) / count(*) ELSE sum(w * {c}) END AS {c}" for c in ('x', 'y', 'z', 'r', 'g', 'b'))}
    FROM (SELECT *, CASE WHEN n <= 65 THEN 1e0 / n ELSE pow(64e0 / 65e0, n - greatest(i, 65)) / 65e0 END AS w
          FROM (SELECT *, row_number() OVER (PARTITION BY session_id, vx, vy, vz ORDER BY stamp_ns, seq) AS i, count(*) OVER (PARTITION BY session_id, vx, vy, vz) AS n
                FROM (SELECT *, {_CELL.format(s='{voxel}')} FROM S_point)))
    GROUP BY ALL"""


def _fused(t: Tables, voxel: float, normals: bool = False) -> DataFrame:
    rows = t.points()
    if normals:
        rows = rows.withColumns({"ox": F.lit(0.0), "oy": (F.col("stamp_ns") % 7).cast("double"), "oz": F.lit(9.0)})
    return points.fuse_surfels(rows, voxel, normals=normals)


@query("D10", sql(f"""
    SELECT session_id, vx, vy, vz, observation_count, updated_at, {_q('confidence')} AS confidence, {_qn('x', '1e5')} AS x, {_qn('y', '1e5')} AS y, {_qn('z', '1e5')} AS z,
           CASE WHEN observation_count <= 65 THEN CAST(floor(r + 0.5e0) AS BIGINT) END AS r
    FROM ({_FUSED.format(voxel='1e0')})""", "S_point"))
def fused_surfels(t: Tables) -> DataFrame:
    rows = _fused(t, 1.0)
    red = F.when(F.col("observation_count") <= 65, F.col("r").cast("bigint")).alias("r")
    return rows.select("session_id", "vx", "vy", "vz", "observation_count", "updated_at", quantize(F.col("confidence")).alias("confidence"), *[_near(F.col(c), 1e5).alias(c) for c in "xyz"], red)


_BLEND = f"""
    WITH RECURSIVE seen AS MATERIALIZED (
        SELECT session_id, vx, vy, vz, i, dx / l AS ix, dy / l AS iy, dz / l AS iz FROM (
            SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l, row_number() OVER (PARTITION BY session_id, vx, vy, vz ORDER BY stamp_ns, seq) AS i
            FROM (SELECT *, -x AS dx, stamp_ns % 7 - y AS dy, 9e0 - z AS dz, {_CELL.format(s='0.5e0')} FROM S_point))),
    blend AS (
        SELECT session_id, vx, vy, vz, i, ix AS nx, iy AS ny, iz AS nz FROM seen WHERE i = 1
        UNION ALL
        SELECT session_id, vx, vy, vz, i, ux / l, uy / l, uz / l FROM (
            SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM (
                SELECT s.session_id, s.vx, s.vy, s.vz, s.i, b.nx * least(b.i, 64) + s.ix AS ux, b.ny * least(b.i, 64) + s.iy AS uy, b.nz * least(b.i, 64) + s.iz AS uz
                FROM blend b JOIN seen s ON s.session_id = b.session_id AND s.vx = b.vx AND s.vy = b.vy AND s.vz = b.vz AND s.i = b.i + 1)))"""


@query("D10", sql(f"""{_BLEND}
    SELECT session_id, vx, vy, vz, {_qn('arg_max(nx, i)', '1e6')} AS nx, {_qn('arg_max(ny, i)', '1e6')} AS ny, {_qn('arg_max(nz, i)', '1e6')} AS nz FROM blend GROUP BY ALL""", "S_point"))
def blended_normals(t: Tables) -> DataFrame:
    return _fused(t, 0.5, True).select("session_id", "vx", "vy", "vz", *[_near(F.col(c), 1e6).alias(c) for c in ("nx", "ny", "nz")])


_FACE = """,
    spans AS (
        SELECT *, hx / h AS tx, hy / h AS ty, hz / h AS tz FROM (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS h FROM (
            SELECT *, CASE WHEN abs(ny) < 0.9e0 THEN nz ELSE 0e0 END AS hx, CASE WHEN abs(ny) < 0.9e0 THEN 0e0 ELSE -nz END AS hy, CASE WHEN abs(ny) < 0.9e0 THEN -nx ELSE ny END AS hz
            FROM (SELECT session_id, vx, vy, vz, arg_max(nx, i) AS nx, arg_max(ny, i) AS ny, arg_max(nz, i) AS nz FROM blend GROUP BY ALL))))"""


@query("D10 H13", sql(f"""{_BLEND}{_FACE}
    SELECT session_id, vx, vy, vz, corner, {_qn('x + (tx * along + (ny * tz - nz * ty) * across) * 0.045e0', '1e5')} AS x, {_qn('y + (ty * along + (nz * tx - nx * tz) * across) * 0.045e0', '1e5')} AS y, {_qn('z + (tz * along + (nx * ty - ny * tx) * across) * 0.045e0', '1e5')} AS z
    FROM spans JOIN ({_FUSED.format(voxel='0.5e0')}) USING (session_id, vx, vy, vz), (VALUES (0, 1e0, 0e0), (1, -0.5e0, 0.86e0), (2, -0.5e0, -0.86e0)) k(corner, along, across)""", "S_point"))
def surfel_normals(t: Tables) -> DataFrame:
    """Fused surfels with normals, as preview triangles."""
    corners = surfel_triangles(_fused(t, 0.5, True))
    return corners.select("session_id", "vx", "vy", "vz", "corner", *[_near(F.col(c), 1e5).alias(c) for c in "xyz"])


_UPRIGHT = "abs(ny) < 0.9e0"


@query("H13", sql(f"""
    SELECT session_id, frame, seq, {_qn('x + tx * rad')} AS x0, {_qn('y + ty * rad')} AS y0, {_qn('z - tz * rad * 0.5e0 + bz * rad * 0.86e0')} AS z1, {_qn('x - tx * rad * 0.5e0 - bx * rad * 0.86e0')} AS x2
    FROM (SELECT *, ny * tz - nz * ty AS bx, nx * ty - ny * tx AS bz FROM (
        SELECT *, hx / h AS tx, hy / h AS ty, hz / h AS tz FROM (
            SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS h FROM (
                SELECT *, CASE WHEN {_UPRIGHT} THEN nz ELSE 0e0 END AS hx, CASE WHEN {_UPRIGHT} THEN 0e0 ELSE -nz END AS hy, CASE WHEN {_UPRIGHT} THEN -nx ELSE ny END AS hz FROM (
                    SELECT *, (x + 1e0) / l AS nx, (y - 2e0) / l AS ny, (z + 1e0) / l AS nz, least(greatest(r / 5000e0, 0.008e0), 0.045e0) AS rad FROM (
                        SELECT *, sqrt((x + 1e0) * (x + 1e0) + (y - 2e0) * (y - 2e0) + (z + 1e0) * (z + 1e0)) AS l FROM S_point))))))""", "S_point"))
def surfel_corners(t: Tables) -> DataFrame:
    """Every point as a surfel."""
    rows = t.points().withColumns({"nx": F.col("x") + 1, "ny": F.col("y") - 2, "nz": F.col("z") + 1, "radius": F.col("r") / F.lit(5000.0)})
    corners = surfel_triangles(rows, ["session_id", "frame", "seq"])

    def one(corner: int, axis: str) -> Column:
        return _near(F.max(F.when(F.col("corner") == corner, F.col(axis))), 1e4).alias(f"{axis}{corner}")

    return corners.groupBy("session_id", "frame", "seq").agg(one(0, "x"), one(0, "y"), one(1, "z"), one(2, "x"))


@query("F2", sql(f"SELECT session_id, vx, vy, vz FROM ({_FUSED.format(voxel='0.5e0')}) ORDER BY confidence DESC, updated_at DESC, vx, vy, vz LIMIT 100", "S_point"))
def best_surfels(t: Tables) -> DataFrame:
    return points.top_surfels(_fused(t, 0.5), 100).select("session_id", "vx", "vy", "vz")


@query("F2 F3", sql(f"""
    SELECT session_id, vx, vy, vz FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, vx, vy, vz) AS k FROM ({_FUSED.format(voxel='0.5e0')})) WHERE k <= 50
    INTERSECT SELECT session_id, vx, vy, vz FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, updated_at DESC, vx, vy, vz) AS k FROM ({_FUSED.format(voxel='0.5e0')})) WHERE k <= 90""", "S_point"))
def kept_surfels(t: Tables) -> DataFrame:
    """Newest surfels of each session that are also among its best."""
    fused = _fused(t, 0.5)
    cell = ["session_id", "vx", "vy", "vz"]
    return points.trim_surfels(fused, 50).select(*cell).join(points.top_surfels_per(fused, 90).select(*cell), cell, "left_semi")


# --- artifacts and payloads ----------------------------------------------------------------------------------------------


@query("A11", sql("""
    SELECT session_id, CASE WHEN session_id = 0 THEN 'depth_anything_lidar_calibrated_full_resolution' WHEN session_id < 4 THEN 'fused_depth_pointcloud' ELSE 'overlay_mesh_vertices' END AS source,
           count(*) AS points, CAST(sum(CASE WHEN session_id < 4 THEN r ELSE 255 END) AS BIGINT) AS red
    FROM S_point GROUP BY session_id""", "S_point"))
def final_points(t: Tables) -> DataFrame:
    rows = t.points()
    chosen = points.final_artifact(rows.filter("session_id = 0"), rows.filter("session_id < 4"), rows)
    return chosen.groupBy("session_id", "source").agg(F.count("*").alias("points"), F.sum("r").cast("bigint").alias("red"))


@query("A8", sql("""
    SELECT 1 AS section, frame * 8 + session_id AS position, printf('%.6f %.6f %.6f %d %d %d', CAST(CAST(x AS FLOAT) AS DOUBLE), CAST(CAST(y AS FLOAT) AS DOUBLE), CAST(CAST(z AS FLOAT) AS DOUBLE), r, g, b) AS value FROM S_point
    UNION ALL SELECT 0, 0, concat_ws(chr(10), 'ply', 'format ascii 1.0', 'comment final point cloud', 'comment source: s', 'comment coordinate_frame: map', 'comment captured_at: then', 'element vertex ' || count(*),
        'property float x', 'property float y', 'property float z', 'property uchar red', 'property uchar green', 'property uchar blue', 'end_header') FROM S_point""", "S_point"))
def ply_lines(t: Tables) -> DataFrame:
    rows = t.points().withColumn("position", F.col("frame") * 8 + F.col("session_id"))
    return artifacts.ply_lines(rows, "position", "s", "map", "then")


@query("A10", sql("""
    SELECT '{"captured_at":"2024-01-01T00:00:00Z","coordinate_frame":"map","metadata":{"k":"v"},"ply_file":"final_pointcloud.ply","point_count":' || count(*) || ',"schema_version":1,"source":"s"}' AS value FROM S_point""", "S_point"))
def pointcloud_sidecar(t: Tables) -> DataFrame:
    return artifacts.pointcloud_metadata(t.points(), "s", "map", "2024-01-01T00:00:00Z", {"k": "v"})


def _clouds(t: Tables) -> DataFrame:
    rows = t.points().withColumn("stamp_ns", whole_div(F.col("frame"), 512))
    return payloads.collect_cloud(rows.withColumn("seq", F.struct("frame", "seq")))


@query("H3", sql("""
    SELECT session_id, frame // 512 AS stamp_ns, count(*) AS width, 16 * count(*) AS row_step, (16 * count(*) + 2) // 3 * 4 AS text_bytes FROM S_point GROUP BY ALL""", "S_point"))
def cloud_messages(t: Tables) -> DataFrame:
    return _clouds(t).select("session_id", "stamp_ns", "width", "row_step", F.length("data").cast("bigint").alias("text_bytes"))


@query("H1 H3", sql("""
    SELECT session_id, stamp_ns, row_number() OVER (PARTITION BY session_id, stamp_ns ORDER BY frame, s) - 1 AS seq,
           CAST(floor(CAST(CAST(x AS FLOAT) AS DOUBLE) * 1e6 + 0.371931e0) AS BIGINT) AS x, CAST(floor(CAST(CAST(y AS FLOAT) AS DOUBLE) * 1e6 + 0.371931e0) AS BIGINT) AS y, r, g, b
    FROM (SELECT session_id, frame // 512 AS stamp_ns, frame, seq AS s, x, y, r, g, b FROM S_point)""", "S_point"))
def cloud_points(t: Tables) -> DataFrame:
    """Points packed into messages and read back: single precision is what the payload holds."""
    out = payloads.explode_cloud(_clouds(t))
    return out.select("session_id", "stamp_ns", "seq", _near(F.col("x"), 1e6).alias("x"), _near(F.col("y"), 1e6).alias("y"), *[F.col(c).cast("bigint").alias(c) for c in "rgb"])


@query("H2", sql(f"""
    SELECT session_id, vx AS stamp_ns, row_number() OVER (PARTITION BY session_id, vx ORDER BY vy, vz) - 1 AS seq, observation_count,
           CAST(floor(CAST(CAST(least(1e0, 0.2e0 + 0.04e0 * (observation_count - 1)) AS FLOAT) AS DOUBLE) * 1e5 + 0.371931e0) AS BIGINT) AS confidence,
           {_qn('CAST(CAST(x AS FLOAT) AS DOUBLE)', '1e3')} AS x, {_qn('CAST(CAST(y AS FLOAT) AS DOUBLE)', '1e3')} AS y, {_qn('CAST(CAST(z AS FLOAT) AS DOUBLE)', '1e3')} AS z, 0 AS nx, 1000 AS ny, 0 AS nz, 375 AS radius
    FROM ({_FUSED.format(voxel='0.5e0')})""", "S_point"))
def surfel_payloads(t: Tables) -> DataFrame:
    fused = _fused(t, 0.5).withColumns({"normal_x": F.lit(0.0), "normal_y": F.lit(1.0), "normal_z": F.lit(0.0)})
    rows = fused.withColumns({"stamp_ns": F.col("vx"), "seq": F.struct("vy", "vz")})
    out = payloads.explode_surfel_cloud(payloads.collect_surfels(rows))
    place = [_near(F.col(c), 1e3).alias(n) for c, n in (("x", "x"), ("y", "y"), ("z", "z"), ("normal_x", "nx"), ("normal_y", "ny"), ("normal_z", "nz"), ("radius", "radius"))]
    return out.select("session_id", "stamp_ns", "seq", "observation_count", _near(F.col("confidence"), 1e5).alias("confidence"), *place)


@query("H14", sql(f"""
    SELECT frame, px, py, {_qn('frame + (px + 0.5e0) / 32', '1e6')} AS lon, {_qn('10e0 - (py + 0.5e0) / 32 * 2e0', '1e6')} AS lat, {_qn('depth', '1e5')} AS alt FROM S_depth""", "S_depth"))
def terrain_points(t: Tables) -> DataFrame:
    f = F.col("frame").cast("double")
    bounds = F.struct(f.alias("west"), F.lit(8.0).alias("south"), (f + 1).alias("east"), F.lit(10.0).alias("north"))
    pixels = t.depth().select("frame", "px", "py", F.col("px").alias("col"), F.col("py").alias("row"), F.col("depth").alias("value"), bounds.alias("bounds"), F.lit(32).alias("width"), F.lit(32).alias("height"))
    out = points.terrain_points(pixels)
    return out.select("frame", "px", "py", _near(F.col("lon"), 1e6).alias("lon"), _near(F.col("lat"), 1e6).alias("lat"), _near(F.col("alt"), 1e5).alias("alt"))
