"""Plans are built without running anything, and first-n filters reach below the shuffle."""

import pytest
from pyspark.sql import functions as F

from terralog.operators import calibration, gates, geo, joins, mesh, points, quality, telemetry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    base = spark.range(1000).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("row_id"), (F.col("id") * 1000).alias("stamp_ns"), F.lit(7).alias("bytes"), F.lit("p" * 50).alias("data"))
    return base.withColumns({c: F.rand(1) for c in ("x", "y", "z", "confidence")} | {c: F.lit(0).cast("bigint") for c in ("vx", "vy", "vz")} | {"updated_at": F.col("row_id")})


def frames_of(rows):
    sizes = {c: F.lit(8) for c in ("relative_w", "relative_h", "lidar_w", "lidar_h", "confidence_w", "confidence_h")}
    return rows.withColumns(sizes | {"frame": F.col("row_id"), "scale": F.lit(1.0), "offset": F.lit(0.0), "m": F.array_repeat(F.lit(0.0), 16)})


def meshes_of(spark):
    vertex = spark.range(30).select((F.col("id") % 3).alias("mesh_id"), F.col("id").alias("vid"), *[F.lit(0.0).alias(c) for c in "xyz"])
    face = vertex.select("mesh_id", F.col("vid").alias("fid"), *[F.lit(0).cast("bigint").alias(c) for c in "abc"])
    meshes = spark.range(3).select(F.lit(0).alias("snapshot_id"), F.col("id").alias("mesh_id"), F.col("id").alias("mesh_order"), F.array_repeat(F.lit(0.0), 16).alias("m"))
    return face, vertex, meshes


def windows_of(df):
    """Partitioning columns of every window in the plan, with whether it stands on an aggregate (one row per stretch)."""
    import re

    lines = plan_of(df).splitlines()
    out = []
    for k, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            spec = re.search(r"windowspecdefinition\((.*?) (?:ASC|DESC)", line)
            below = [x for x in lines[k + 1 : k + 7]]
            out.append((spec.group(1), any("HashAggregate" in x or "SortAggregate" in x or "ObjectHashAggregate" in x for x in below)))
    return out


def test_no_window_over_the_rows_of_a_session(spark, rows):
    tied = rows.withColumn("seq", F.col("row_id"))
    fixes = tied.select("session_id", "stamp_ns", "seq", *[F.lit(1.0).alias(c) for c in ("lat", "lon", "alt", "hacc")])
    plans = [
        joins.asof_join(tied, tied, ["session_id"], "stamp_ns", "stamp_ns", ["x"], left_tie=["seq"], right_tie=["seq"]), geo.georeference(fixes, tied),
        geo.odometry_twist(tied.withColumns({f"q{c}": F.lit(0.5) for c in "xyzw"})), telemetry.staleness(rows, ["session_id"], "stamp_ns", "row_id"),
        telemetry.thermal_interval(rows.withColumn("state", F.lit("nominal")), ["session_id"], ["stamp_ns", "row_id"]),
        quality.check_clock(rows.withColumns({"topic": F.lit("t"), "recv_ns": F.col("stamp_ns")})),
        joins.radio_position(tied.drop("x", "y", "z"), tied, fixes, 10**9), calibration.reuse_calibration(frames_of(tied)),
    ]
    for plan in plans:
        found = windows_of(plan)
        assert found
        for columns, on_summary in found:
            assert "_blk" in columns or on_summary, (columns, plan_of(plan))


def test_no_face_reaches_python(spark):
    assert "Python" not in plan_of(mesh.triangle_soup(*meshes_of(spark), 9)) and "InArrow" not in plan_of(mesh.triangle_soup(*meshes_of(spark), 9))


def test_nothing_runs_before_the_action(spark, rows):
    tied = rows.withColumn("seq", F.col("row_id"))
    spark.sparkContext.setJobGroup("lazy", "plans only")
    try:
        built = [
            gates.rate_gate(rows, ["session_id"], 5000), gates.assign_chunks(rows, 100), points.trim_surfels(rows, 10), points.top_surfels_per(rows, 10),
            joins.asof_join(tied, tied, ["session_id"], "stamp_ns", "stamp_ns", ["x"], left_tie=["seq"], right_tie=["seq"]),
            telemetry.staleness(rows, ["session_id"], "stamp_ns", "row_id"), geo.odometry_twist(tied.withColumns({f"q{c}": F.lit(0.5) for c in "xyzw"})),
            points.fuse_surfels(tied.withColumns({c: F.lit(1) for c in ("r", "g", "b", "ox", "oy", "oz")})), quality.check_clock(rows.withColumns({"topic": F.lit("t"), "recv_ns": F.col("stamp_ns")})),
            calibration.reuse_calibration(frames_of(tied)), mesh.triangle_soup(*meshes_of(spark), 9),
        ]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(built) == 11


def test_first_n_is_cut_before_the_shuffle(spark, rows):
    assert "WindowGroupLimit" in plan_of(points.trim_surfels(rows, 10))
    assert "WindowGroupLimit" in plan_of(points.top_surfels_per(rows, 10))
    vertex = spark.range(30).select((F.col("id") % 3).alias("mesh_id"), F.col("id").alias("vid"), *[F.lit(0.0).alias(c) for c in "xyz"])
    face = vertex.select("mesh_id", F.col("vid").alias("fid"), *[F.lit(0).cast("bigint").alias(c) for c in "abc"])
    meshes = spark.createDataFrame([(0, m, m) for m in range(3)], "snapshot_id bigint, mesh_id bigint, mesh_order bigint")
    assert "WindowGroupLimit" in plan_of(mesh.triangle_budget(face, vertex, meshes, 5))


def test_only_narrow_columns_reach_python(rows):
    plan = plan_of(gates.rate_gate(rows, ["session_id"], 5000))
    python = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "data" not in python


def test_merged_faces_are_counted_in_stretches_of_a_mesh(spark):
    rows = [(m, v, 0.0, 0.0, 0.0) for m in range(3) for v in range(5)]
    vertex = spark.createDataFrame(rows, "mesh_id bigint, vid bigint, x double, y double, z double")
    corners = [(m, f, (f * 2 + m) % 7 - 1, f % 6, 4) for m in range(3) for f in range(11)]
    face = spark.createDataFrame(corners, "mesh_id bigint, fid bigint, a bigint, b bigint, c bigint")
    unit = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    meshes = vertex.select("mesh_id").distinct().select(F.lit(0).alias("snapshot_id"), "mesh_id", (-F.col("mesh_id")).alias("mesh_order"), unit.alias("m"))
    _, merged = mesh.merge_meshes(face, vertex, meshes)
    listed = [(2 - m) * 5 + v for m in (2, 1, 0) for k, _, *abc in corners if k == m for v in abc if 0 <= v < 5]
    want = [(i, *listed[3 * i : 3 * i + 3]) for i in range(len(listed) // 3)]
    assert sorted(tuple(r) for r in merged.select("fid", "a", "b", "c").collect()) == want
    windows = [line for line in merged._jdf.queryExecution().analyzed().toString().split("\n") if "Window" in line]
    assert not any("mesh_order" in w and "fid" in w for w in windows), windows
