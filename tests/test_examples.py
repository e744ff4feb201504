"""Worked examples with known outcomes."""

import base64
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from terralog import dimensions
from terralog.functions import camera, geodesy, localization, names, radio, tiles
from terralog.operators import calibration, geo, log, mesh, payloads, points, quality, telemetry
from tests.conftest import rows

POINT = "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, r int, g int, b int"
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def cloud(spark, places, colours=None):
    colours = colours or [(1, 2, 3)] * len(places)
    return spark.createDataFrame([("s", i, i, *map(float, p), *c) for i, (p, c) in enumerate(zip(places, colours))], POINT)


def test_outliers(spark):
    near = [(1.0, 2.0, 3.0), (1.02, 2.0, 3.0), (1.0, 2.03, 3.0), (1.01, 2.01, 3.04)]
    assert len(rows(points.remove_outliers(cloud(spark, near + [(30, 0, 0)])).select("seq"))) == 4


def test_voxels(spark):
    df = cloud(spark, [(0.01, 0.01, 0.01), (0.02, 0.02, 0.02), (0.04, 0.01, 0.03), (1, 1, 1)])
    assert rows(points.voxel_filter(df, 0.05, ["seq"]).select("seq")) == [(0,), (3,)]


def depth_grid(spark, size, relative, lidar=None):
    data = [(1, x, y, float(relative(x, y)), float(lidar(relative(x, y))) if lidar else None, 2) for y in range(size) for x in range(size)]
    return spark.createDataFrame(data, "frame bigint, px int, py int, relative double, depth double, confidence int")


def one_camera(spark, size, focal):
    data = [(1, float(focal), float(focal), size / 2, size / 2, size, size, size, size, IDENTITY)]
    return spark.createDataFrame(data, "frame bigint, fx double, fy double, cx double, cy double, image_w int, image_h int, depth_w int, depth_h int, m array<double>")


def test_fused_cloud(spark):
    grid = depth_grid(spark, 32, lambda x, y: 0.5 + (x + y) / 64, lambda r: 2 * r + 0.5).withColumns({"luma": F.lit(128), "cb": F.lit(128), "cr": F.lit(128)})
    fits = calibration.fit_calibration(grid.withColumnsRenamed({"px": "lx", "py": "ly"}))
    fit = fits.first()
    assert abs(fit["scale"] - 2.0) < 1e-3 and abs(fit["offset"] - 0.5) < 1e-3
    got = points.calibrated_cloud(grid, one_camera(spark, 32, 24), fits).collect()
    assert len(got) == 1024 and all(-3.5 < p["z"] < -1.4 for p in got) and {p["r"] for p in got} == {128}


def test_cloud_beyond_sensor_range(spark):
    flat = spark.createDataFrame([(1, 2.0, 0.0)], "frame bigint, scale double, offset double")
    got = points.calibrated_cloud(depth_grid(spark, 8, lambda x, y: 6.0), one_camera(spark, 8, 8), flat).collect()
    assert len(got) == 64 and {p["z"] for p in got} == {-12.0}


def test_fit_gates(spark):
    grid = depth_grid(spark, 16, lambda x, y: 0.5 + (x + y) / 64, lambda r: 2 * r + 0.5)  # 16 samples only
    assert rows(calibration.fit_calibration(grid.withColumnsRenamed({"px": "lx", "py": "ly"})).select("samples", "scale")) == [(16, None)]
    level = depth_grid(spark, 32, lambda x, y: 1.0, lambda r: 2.0)
    assert rows(calibration.fit_affine(level.withColumnsRenamed({"px": "lx", "py": "ly"})).select("samples", "scale")) == [(64, None)]


def test_affine(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,)], "r double")
    assert rows(df.select(camera.affine_depth(F.col("r"), F.lit(4.0), F.lit(1.0)))) == [(1.0,), (2.0,), (3.0,), (5.0,)]


def test_grid_mesh(spark):
    flat = spark.createDataFrame([(1, 2.0, 0.0)], "frame bigint, scale double, offset double")
    vertex, face = mesh.grid_mesh(depth_grid(spark, 4, lambda x, y: 1.0), one_camera(spark, 4, 4), flat)
    assert vertex.count() == 16 and face.count() * 3 == 54
    assert tuple(face.orderBy("fid").first())[2:] == (0, 4, 1)


def test_grid_mesh_with_gaps_and_steps(spark):
    """Against a plain loop: holes, depth jumps, a step that does not divide the size, a triangle limit."""
    def relative(x, y):
        return 0.0 if (x * 7 + y * 3) % 11 == 0 else 1.0 + ((x + 2 * y) % 5) * 0.2

    flat = spark.createDataFrame([(1, 1.0, 0.0)], "frame bigint, scale double, offset double")
    for step, limit in ((1, 600_000), (3, 600_000), (2, 7)):
        vertex, face = mesh.grid_mesh(depth_grid(spark, 12, relative), one_camera(spark, 12, 12), flat, step, limit)
        index = list(range(0, 12, step)) + ([11] if 11 % step else [])
        ids, depths, want = {}, {}, []
        for r, y in enumerate(index):
            for c, x in enumerate(index):
                if relative(x, y) > 0.1:
                    ids[r, c], depths[r, c] = len(ids), relative(x, y)
        for r in range(len(index) - 1):
            for c in range(len(index) - 1):
                for corners in (((r, c), (r + 1, c), (r, c + 1)), ((r, c + 1), (r + 1, c), (r + 1, c + 1))):
                    if all(k in ids for k in corners):
                        d = [depths[k] for k in corners]
                        if max(d) - min(d) <= max(0.45, min(d) * 0.18):
                            want.append(tuple(ids[k] for k in corners))
        got = [tuple(f)[2:] for f in face.orderBy("fid").collect()]
        assert got == want[:limit] and vertex.count() == len(ids)


def test_surfels(spark):
    df = cloud(spark, [(0.01, 0.01, 0.01), (0.02, 0.02, 0.02)], [(200, 0, 0), (100, 0, 0)]).withColumns({"ox": F.lit(0.0), "oy": F.lit(1.0), "oz": F.lit(0.0)})
    got = points.fuse_surfels(df).collect()
    assert len(got) == 1 and got[0]["observation_count"] == 2 and got[0]["confidence"] > 0.2 and 100 < got[0]["r"] < 200


def test_top_and_trimmed_surfels(spark):
    df = cloud(spark, [(i, 0, 0) for i in range(5)])
    fused = points.fuse_surfels(df, normals=False)
    assert rows(points.top_surfels(fused, 2).select("updated_at")) == [(3,), (4,)]
    assert rows(points.trim_surfels(fused, 3).select("updated_at")) == [(2,), (3,), (4,)]


def test_camera_matrices(spark):
    m = spark.range(1).select(camera.camera_matrices(F.lit(600.0), F.lit(590.0), F.lit(320.0), F.lit(240.0)).alias("m")).first()["m"]
    assert m["k"] == [600, 0, 320, 0, 590, 240, 0, 0, 1] and m["p"] == [600, 0, 320, 0, 0, 590, 240, 0, 0, 0, 1, 0]
    v = spark.range(1).select(camera.diag_covariance(*camera.TWIST_DIAGONAL).alias("v")).first()["v"]
    assert len(v) == 36 and [v[i * 7] for i in range(6)] == list(camera.TWIST_DIAGONAL) and sum(v) == pytest.approx(0.15)


def test_cloud_bytes(spark):
    message = payloads.collect_cloud(cloud(spark, [(1, 2, 3)], [(10, 20, 30)])).first()
    assert base64.b64decode(message["data"]) == struct.pack("<fffI", 1, 2, 3, (10 << 16) | (20 << 8) | 30)
    assert (message["point_step"], message["row_step"], message["width"], len(message["fields"])) == (16, 16, 1, 4)
    back = payloads.explode_cloud(payloads.collect_cloud(cloud(spark, [(1, 2, 3)], [(10, 20, 30)])))
    assert rows(back.select("x", "y", "z", "r", "g", "b")) == [(1.0, 2.0, 3.0, 10, 20, 30)]


def test_surfel_bytes(spark):
    one = spark.createDataFrame([("s", 1, 0, 1.0, 2.0, 3.0, 0.0, 1.0, 0.0, 0.03, 0.5, 1, 2, 3, 7)], "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, normal_x double, normal_y double, normal_z double, radius double, confidence double, r int, g int, b int, observation_count bigint")
    message = payloads.collect_surfels(one).first()
    assert len(base64.b64decode(message["data"])) == 40 and len(message["fields"]) == 10
    assert rows(payloads.explode_surfel_cloud(payloads.collect_surfels(one)).select("observation_count", "confidence", "b")) == [(7, 0.5, 3)]


def test_cloud_with_other_layout(spark):
    """Field offsets and step of the message decide, not the usual layout."""
    blob = struct.pack("<IfffIf", 9, 3.0, 2.0, 1.0, 0x0A0B0C, 0.0)
    fields = [("z", 12, 7, 1), ("y", 8, 7, 1), ("x", 4, 7, 1), ("rgb", 16, 6, 1)]
    df = spark.createDataFrame([("s", 1, 24, fields, base64.b64encode(blob * 2).decode())], "session_id string, stamp_ns bigint, point_step int, fields array<struct<name:string,offset:int,datatype:int,count:int>>, data string")
    assert rows(payloads.explode_cloud(df).select("seq", "x", "y", "z", "r", "g", "b")) == [(0, 3.0, 2.0, 1.0, 10, 11, 12), (1, 3.0, 2.0, 1.0, 10, 11, 12)]


def mesh_tables(spark, vertices, faces, matrix=None):
    matrix = matrix or IDENTITY
    vertex = spark.createDataFrame([(m, i, *map(float, p)) for m, vs in vertices.items() for i, p in enumerate(vs)], "mesh_id bigint, vid bigint, x double, y double, z double")
    face = spark.createDataFrame([(m, i, *f) for m, fs in faces.items() for i, f in enumerate(fs)], "mesh_id bigint, fid bigint, a bigint, b bigint, c bigint")
    meshes = spark.createDataFrame([("snap", m, m, matrix) for m in vertices], "snapshot_id string, mesh_id bigint, mesh_order bigint, m array<double>")
    return face, vertex, meshes


def test_packed_mesh(spark):
    moved = IDENTITY.copy()
    moved[3], moved[7], moved[11] = 10.0, 20.0, 30.0
    face, vertex, meshes = mesh_tables(spark, {1: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]}, {1: [(0, 1, 2), (0, 2, 3)]}, moved)
    packed = mesh.collect_snapshot(face, vertex, meshes).first()
    assert (packed["vertex_count"], packed["triangle_count"], packed["is_truncated"]) == (4, 2, False)
    assert struct.unpack("<fff", base64.b64decode(packed["vertex_data"])[:12]) == (10, 20, 30)
    assert struct.unpack("<6I", base64.b64decode(packed["index_data"])) == (0, 1, 2, 0, 2, 3)


@pytest.mark.parametrize("n", [None, 25])
def test_snapshot_faces_are_numbered_in_one_stream(spark, n):
    r = random.Random(5)
    vertices = {m: [(0, 0, 0)] * r.randint(3, 12) for m in range(6)}
    faces = {m: [tuple(r.randint(-1, len(v)) for _ in range(3)) for _ in range(r.randint(0, 60))] + [(1, 1, 0)] for m, v in vertices.items()}
    face, vertex, meshes = mesh_tables(spark, vertices, faces)
    meshes = meshes.withColumn("mesh_order", -F.col("mesh_id")).unionByName(meshes.filter("mesh_id > 2").withColumn("snapshot_id", F.lit("other")))
    budget = mesh.triangle_budget(face, vertex, meshes, n)
    remap = mesh.remap_vertices(budget)
    plain = mesh.remapped_faces(budget, remap)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # meshes and snapshots are cut over batches
    try:
        numbered = mesh.numbered_faces(face, vertex, meshes, n)
        found = numbered.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((f.snapshot_id, f.tri, f.ga, f.gb, f.gc) for f in found) == rows(plain.select("snapshot_id", "tri", "a", "b", "c"))
    first = {(f.snapshot_id, f.mesh_id, f[x], (f.tri - 1) * 3 + k, f[f"g{x}"]) for f in found for k, x in enumerate("abc") if f[f"n{x}"]}
    assert sorted(first) == rows(remap.select("snapshot_id", "mesh_id", "vid", "first", "gid"))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Join") == 2  # counts and meshes; no row per corner, no join back


def test_payload_limit(spark):
    n = 3000
    face, vertex, meshes = mesh_tables(spark, {1: [(i, i % 7, 0) for i in range(n * 3)]}, {1: [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(n)]})
    packed = mesh.collect_snapshot(face, vertex, meshes, 9000, 16_000).first()
    assert packed["is_truncated"] and 0 < packed["triangle_count"] < n and packed["published_payload_bytes"] <= 16_000
    assert packed["vertex_count"] == 3 * packed["triangle_count"] and len(base64.b64decode(packed["vertex_data"])) == 12 * packed["vertex_count"]
    lists = spark.createDataFrame([(600, 9000), (600, 30), (20_000, 9000)], "base_bytes bigint, points bigint")
    fitted = {(r["base_bytes"], r["points"]): r["fitted"] for r in payloads.fit_points(lists, 16_000).collect()}
    assert fitted[600, 30] == 30 and fitted[20_000, 9000] == 0
    assert 0 < fitted[600, 9000] < 9000 and fitted[600, 9000] % 3 == 0


@pytest.mark.parametrize("limit", [None, 7])
def test_marker_limit(spark, limit):
    """Against all ways to cut, longest first."""
    data = [(1, m, p, 20, 100) for m, n in ((0, 30), (1, 61), (2, 9)) for p in range(n)]
    df = spark.createDataFrame(data, "message_id bigint, marker bigint, position bigint, point_bytes bigint, marker_bytes bigint")
    whole = [30, 61, 9]
    ways = [whole[:m] + [k] for m in range(3) for k in range(1, whole[m] + 1) if k % 3 == 0 or k == whole[m]]
    size = {tuple(w): 50 + sum(100 + 20 * k + k - 1 for k in w) + len(w) - 1 for w in ways}
    for most in (130, 300, 1500, 2050, 2200, 9999):
        best = max((w for w in size if size[w] <= most), key=sum, default=())
        assert rows(payloads.fit_markers(df, 50, most, limit).select("marker", "kept")) == list(enumerate(best))


def test_point_limit_is_the_largest(spark):
    lists = spark.createDataFrame([(b, 3 * k) for b in (0, 100, 4990, 6000) for k in (0, 1, 2, 31, 32, 33, 74, 75, 76, 77, 78, 500)], "base_bytes bigint, points bigint")
    for r in payloads.fit_points(lists, 5000).collect():
        n = r["points"] // 3
        fits = [k for k in range(n + 1) if r["base_bytes"] + (4 if k < n else 5) + 64 * k + len(str(k)) + len(str(3 * k)) <= 5000]
        assert r["fitted"] == 3 * max(fits, default=0)


def test_bad_faces_and_budgets(spark):
    face, vertex, meshes = mesh_tables(spark, {1: [(0, 0, 0), (1, 0, 0), (0, 1, 0)], 2: [(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)]}, {1: [(0, 1, 9), (0, 1, 2), (2, 1, 0)], 2: [(0, 1, 2), (1, 2, 3)]})
    assert rows(mesh.triangle_budget(face, vertex, meshes, 2).select("mesh_id", "fid", "tri")) == [(1, 1, 1), (1, 2, 2)]
    # the other budget is used up by the bad face: mesh 1 may take two faces, one of them is bad
    assert rows(mesh.triangle_soup(face, vertex, meshes, 6).select("mesh_id", "fid").distinct()) == [(1, 1), (2, 0)]
    for limit in (None, 2):
        merged_vertex, merged_face = mesh.merge_meshes(face, vertex, meshes, limit)
        # the bad index 9 is dropped and the list is read in threes again: 0 1 0 | 1 2 2 | 1 0 3 | 4 5 4 | (5 6)
        assert rows(merged_face.select("fid", "a", "b", "c")) == [(0, 0, 1, 0), (1, 1, 2, 2), (2, 1, 0, 3), (3, 4, 5, 4)]
        assert merged_vertex.count() == 7


def test_vertex_normals(spark):
    face, vertex, _ = mesh_tables(spark, {1: [(0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 5, 5)]}, {1: [(0, 1, 2), (0, 0, 1)]})
    assert rows(mesh.vertex_normals(face, vertex).select("vid", "nx", "ny", "nz")) == [(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 0.0, 1.0, 0.0)]


# --- geo -----------------------------------------------------------------------------------------------------------------

FIX = "session_id string, seq bigint, stamp_ns bigint, lat double, lon double, alt double, hacc double"
POSE = "session_id string, seq bigint, stamp_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double"


def test_georeference(spark):
    """A second fix about 5 m east, 12 m north and 3 m up of the origin at map (10, 2, -3)."""
    import math

    lat, lon = 39.7392, -104.9903
    up = (lat + math.degrees(12 / 6_356_000), lon + math.degrees(5 / (6_378_137 * math.cos(math.radians(lat)))))
    fixes = spark.createDataFrame([("s", 1, 100, lat, lon, 1600.0, 3.0), ("s", 2, 300, lat, lon, 1600.0, 4.0), ("s", 3, 400, *up, 1603.0, 80.0), ("s", 4, 500, float("nan"), lon, 0.0, 1.0)], FIX)
    poses = spark.createDataFrame([("s", 1, 200, 10.0, 2.0, -3.0, 0.0, 0.0, 0.0, 1.0)], POSE)
    got = {r["seq"]: r for r in geo.georeference(fixes, poses).collect()}
    assert got[1]["reason"] == "waiting_for_arkit_map_pose" and got[1]["map"] is None
    assert tuple(got[2]["map"]) == pytest.approx((10, 2, -3), abs=1e-6)
    assert tuple(got[3]["map"]) == pytest.approx((15, 5, -15), abs=0.1)
    assert got[4]["map"] is None and got[4]["reason"] is None
    edges = geo.tf_rows(poses, geo.first_origin(geo.with_pose(fixes, poses)))
    assert [r["parent"] for r in edges.orderBy("position").collect()] == ["map", "odom", "base_link"]  # the pose is older than the origin


def test_origin_needs_accuracy(spark):
    fixes = spark.createDataFrame([("s", 1, 300, 39.0, -104.0, 1600.0, 50.0)], FIX)
    poses = spark.createDataFrame([("s", 1, 200, 10.0, 2.0, -3.0, 0.0, 0.0, 0.0, 1.0)], POSE)
    assert geo.georeference(fixes, poses, max_accuracy=5.0).first()["reason"] == "waiting_for_accurate_gps_origin"


def test_providers(spark):
    fixes = spark.createDataFrame([("denver", 1, 0, 39.7392, -104.9903, 0.0, 1.0), ("london", 2, 0, 51.5, -0.12, 0.0, 1.0), ("attu", 3, 0, 52.9, 173.0, 0.0, 1.0)], FIX)
    got = {}
    for r in geo.dem_candidates(fixes).orderBy("session_id", "position").collect():
        got.setdefault(r["session_id"], []).append(r["name"])
    both = ["USGS 3DEP", "Mapzen Terrain Tiles"]
    assert got == {"denver": both, "london": both[1:], "attu": both}  # the Alaska box crosses the date line


def test_denver_tile(spark):
    fixes = spark.createDataFrame([("s", 1, 1_700_000_000_000_000_000, 39.7392, -104.9903, 1600.0, 3.0)], FIX)
    for r in geo.tile_requests(fixes).collect():
        b, p = r["bounds"], r["pixel"]
        assert b["west"] <= -104.9903 <= b["east"] and b["south"] <= 39.7392 <= b["north"]
        assert 0 <= p["px"] <= 256 and 0 <= p["py"] <= 256 and " " not in r["path"]
        if r["kind"] == "satellite_imagery":
            assert r["date"] == "2023-11-12" and "/2023-11-12/" in r["source"]
    message = geo.tile_message(geo.tile_requests(fixes)).filter("kind = 'dem'").first()
    assert json.loads(message["source_policy"])["requires_credentials"] is False and set(json.loads(message["bounds"])) == {"west", "south", "east", "north"}


def test_edges_of_the_map(spark):
    df = spark.createDataFrame([(90.0, 200.0), (-90.0, -200.0)], "lat double, lon double")
    keys = df.select(tiles.tile_key(F.col("lat"), F.col("lon"), F.lit(3)).alias("k")).select("k.*")
    assert rows(keys) == [(3, 0, 7), (3, 7, 0)]
    assert rows(df.select(tiles.normal_longitude(F.col("lon")))) == [(-160.0,), (160.0,)]


def test_quaternions(spark):
    """All four branches against the rotation they came from."""
    for axis in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (0.6, 0.8, 0.0)):
        for angle in (0.3, 3.0):
            import math

            c, s = math.cos(angle), math.sin(angle)
            x, y, z = axis
            m = [c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s, 1.0, y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s, 2.0,
                 z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c), 3.0, 0.0, 0.0, 0.0, 1.0]
            p = spark.createDataFrame([(m,)], "m array<double>").select(geodesy.pose_from_matrix(F.col("m")).alias("p")).first()["p"]
            q = p["rotation"]
            assert (p["x"], p["y"], p["z"]) == (1, 2, 3)
            assert (abs(q["qw"]), *(abs(q[k]) for k in ("qx", "qy", "qz"))) == pytest.approx((abs(math.cos(angle / 2)), *(abs(a * math.sin(angle / 2)) for a in axis)), abs=1e-9)


def test_twist(spark):
    import math

    poses = spark.createDataFrame([("s", 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("s", 2, 500_000_000, 1.0, 0.0, 0.0, 0.0, math.sin(0.25), 0.0, math.cos(0.25))], POSE)
    first, second = geo.odometry_twist(poses).orderBy("seq").collect()
    assert [first[c] for c in ("vx", "wx", "wy")] == [0, 0, 0]
    # 2 m/s along world x seen from a body turned half a radian about y
    assert (second["vx"], second["vz"], second["wy"]) == pytest.approx((2 * math.cos(0.5), 2 * math.sin(0.5), 1.0))


# --- telemetry and log ---------------------------------------------------------------------------------------------------


def test_payload_stress(spark):
    df = spark.range(10_000).select(F.lit("camera").alias("stream"), F.col("id").alias("seq"), F.lit(16_000).alias("original_bytes"), F.lit(21_336).alias("encoded_bytes"), F.lit("base64").alias("compression"), F.col("id").alias("ts_ns"))
    got = telemetry.payload_metrics(df).first()
    assert (got["original_bytes_total"], got["encoded_bytes_total"]) == (160_000_000, 213_360_000) and got["compression_ratio"] > 1
    assert got["last_recorded_ns"] == 9999


def test_topic_table(spark):
    dims = dimensions.load_dimensions(spark)
    assert {n: d.count() for n, d in dims.items()} == {"topics": 21, "radio_channels": 5, "platform_restrictions": 3, "providers": 3, "regions": 6, "optional_providers": 5, "rate_targets": 7}
    streams = spark.createDataFrame([(s,) for s in dimensions.DEFAULT_STREAMS], "stream string")
    from terralog.operators.joins import enabled_topics

    on = {r["topic"] for r in enabled_topics(dims["topics"], streams).collect()}
    assert "/mapping/pose" in on and not on & {"/mapping/odom", "/mapping/imu", "/mapping/surfels", "/mapping/mesh_snapshot", "/mapping/map"}


def test_radio_values_are_finite(spark):
    wifi = spark.createDataFrame([("s", 1, "net", "", float("nan"), True, True, False)], "session_id string, stamp_ns bigint, ssid string, bssid string, signal_strength double, is_secure boolean, did_auto_join boolean, did_just_join boolean")
    row = radio.wifi_rows(wifi).first()
    assert row["signal_strength_normalized"] == 0 and row["source_id"] == "net" and row["latitude"] == 0 and row["tags"] == ["wifi", "current_network"]
    assert len(row) == 1 + len(radio.RADIO_DEFAULTS) and len(radio.RADIO_DEFAULTS) == 35


def test_strict_decoding_stops(spark):
    df = spark.createDataFrame([("s", "/t", 1, '{"op":"subscribe","msg":{}}')], "session_id string, topic string, stamp_ns bigint, data string")
    with pytest.raises(Exception, match="unsupported op"):
        log.decode_envelope(df, "strict").collect()


def test_typed_messages(spark):
    msgs = ['{"format":"jpeg","data":"aGVsbG8="}', '{"format":null,"data":[104,105]}', '{"format":"jpeg","data":"***"}', "{}"]
    df = spark.createDataFrame(list(enumerate(msgs)), "id int, msg string")
    good = {r["id"]: r["message"] for r in log.hydrate_good(df, "sensor_msgs/msg/CompressedImage").collect()}
    assert bytes(good[0]["data"]) == b"hello" and bytes(good[1]["data"]) == b"hi" and good[1]["format"] == "" and bytes(good[3]["data"]) == b""
    assert rows(log.hydrate_rejects(df, "sensor_msgs/msg/CompressedImage").select("id")) == [(2,)]
    info = spark.createDataFrame([('{"is_cached":"Yes","zoom":"12","tile_x":3.0,"transforms":1}',)], "msg string")
    m = log.hydrate(info, "mapping_msgs/msg/GeoTileInfo").first()
    assert not m["_failed"] and (m["message"]["is_cached"], m["message"]["zoom"], m["message"]["tile_x"]) == (True, 12, 3)
    tf = spark.createDataFrame([('{"transforms":[{"header":{"stamp":{"sec":1,"nanosec":2},"frame_id":"map"},"transform":{"rotation":{"w":1}}}]}',)], "msg string")
    first = log.hydrate(tf, "tf2_msgs/msg/TFMessage").first()["message"]["transforms"][0]
    assert first["header"]["frame_id"] == "map" and first["transform"]["rotation"]["w"] == 1.0 and first["transform"]["translation"]["x"] == 0.0


@pytest.mark.parametrize("msg, good", [
    ('{"latitude":1,"status":{"status":-128}}', True), ('{"header":5}', False), ('{"header":null}', False), ('{"position_covariance":7}', False),
    ('{"position_covariance":[1,2]}', False), ('{"position_covariance":[1,2,3,4,5,6,7,8,null]}', False), ('{"latitude":null}', False),
    ('{"status":{"status":300}}', False), ('{"status":{"service":-1}}', False), ('{"header":{"frame_id":null}}', True), ('{"header":{"stamp":[1]}}', False), ("[]", False),
])
def test_strict_fields(spark, msg, good):
    row = log.hydrate(spark.createDataFrame([(msg,)], "msg string"), "sensor_msgs/msg/NavSatFix").first()
    assert row["_failed"] is not good
    if good:
        assert len(row["message"]["position_covariance"]) == 9


def test_conversion_can_stop(spark):
    rows_ = [("/legacy/a", "legacy_msgs/PublisherStats", 1, '{"op":"publish","msg":{"depth":3}}'), ("/legacy/a", "legacy_msgs/PublisherStats", 2, '{"op":"publish","msg":{"depth":[]}}')]
    df = spark.createDataFrame(rows_, "topic string, type string, stamp_ns bigint, data string")
    known = ["mapping_msgs/msg/PublisherStats"]
    assert [r["reason"] for r in log.convert(df, known).orderBy("stamp_ns").collect()] == [None, "fields do not fit mapping_msgs/msg/PublisherStats"]
    with pytest.raises(Exception, match="do not fit"):
        log.convert(df, known, mode="fail").collect()


def test_overrides_and_lists(spark, tmp_path):
    table = log.parse_overrides(["/legacy/a=x_msgs/A", "/legacy/a = x_msgs/B"], spark=spark)
    assert rows(table) == [("/mapping/a", "x_msgs/msg/B")]
    with pytest.raises(ValueError):
        log.parse_overrides(["nothing"], spark=spark)
    listed = tmp_path / "topics.txt"
    listed.write_text("/b # second\n\n# none\n/c\n")
    got = [r["topic"] for r in log.topic_list(spark, ["/a", "/b"], files=[str(listed)], extra=["/d", "/a"]).collect()]
    assert got == ["/a", "/b", "/c", "/d"]
    listed.write_text("b\n")
    with pytest.raises(Exception, match="must start"):
        log.topic_list(spark, [], files=[str(listed)]).collect()


def test_convertible(spark):
    from terralog.operators.joins import convertible, require_rows

    topics = spark.createDataFrame([("/a", "x"), ("/b", "y")], "topic string, type string")
    known = spark.createDataFrame([("x",)], "type string")
    assert rows(convertible(topics, known).select("topic")) == [("/a",)]
    with pytest.raises(Exception, match="no schema for /b"):
        convertible(topics, known, "fail").collect()
    with pytest.raises(ValueError):
        require_rows(topics.filter("false"), "no convertible topic")


def test_names(spark):
    df = spark.createDataFrame([(" a; b,,a\n c",), ("",)], "t string")
    assert rows(df.select(F.array_join(names.split_config(F.col("t")), "|"))) == [("",), ("a|b|c",)]
    urls = spark.createDataFrame([("ws://h:1",), ("WSS://u@h/p",), ("http://h",), ("ws://",), ("h",)], "t string")
    assert [r[0] for r in urls.select(names.valid_recorder_url(F.col("t"))).collect()] == [True, True, False, False, False]


def test_clock_and_limits(spark):
    data = [("s", "/t", i, 1_700_000_000_000_000_000 + i * 10**9 - (5 * 10**9 if i == 50 else 0), 1_700_000_000_000_000_000 + int(i * 1.01 * 10**9)) for i in range(100)]
    got = quality.check_clock(spark.createDataFrame(data, "session_id string, topic string, row_id bigint, stamp_ns bigint, recv_ns bigint")).first()
    assert got["backward_steps"] == 1 and abs(got["drift"] - 0.01) < 1e-3


def test_fix_fields(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, float("nan")), (float("nan"), 2.0, 3.0, -1.0, 2.0)], "lat double, lon double, alt double, h double, v double")
    got = [r["m"] for r in df.select(localization.navsat_fix(*[F.col(c) for c in ("lat", "lon", "alt", "h", "v")]).alias("m")).collect()]
    assert (got[0]["status"], got[0]["position_covariance"][8], got[0]["position_covariance_type"]) == (0, 16.0, 1)
    assert (got[1]["status"], got[1]["service"], got[1]["latitude"], got[1]["position_covariance_type"]) == (-1, 0, 0.0, 0)


def test_session_state(spark):
    data = [("s", 1, 10, "started", "active", ["a"], None), ("s", 2, 20, "failed", "failed", ["a"], "lost"), ("s", 3, 30, "stopped", "idle", ["a", "b"], "lost"), ("t", 1, 5, "started", "active", [], None), ("t", 2, 6, "stopped", "idle", [], None), ("t", 3, 7, "started", "active", [], None)]
    df = spark.createDataFrame(data, "session_id string, seq bigint, ts_ns bigint, event string, state string, enabled_streams array<string>, last_error string")
    got = {r["session_id"]: r for r in telemetry.session_state(df).collect()}
    assert (got["s"]["state"], got["s"]["started_ns"], got["s"]["ended_ns"], got["s"]["last_error"]) == ("idle", 10, 30, "lost")
    assert (got["t"]["state"], got["t"]["ended_ns"]) == ("active", None)
