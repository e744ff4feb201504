"""Final artifacts: ASCII point clouds and meshes with JSON sidecars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.numeric import finite_or
from terralog.operators.mesh import valid_faces


def _number(name: str) -> Column:
    """Six decimals of the single-precision value, as C prints it: exact ties go to the even digit, the sign of zero stays."""
    value = finite_or(F.col(name).cast("float").cast("double"), 0.0)
    exact = F.bround(F.abs(value).try_cast("decimal(38,15)"), 6).cast("string")
    signed = F.when(F.startswith(value.cast("string"), F.lit("-")), F.concat(F.lit("-"), exact)).otherwise(exact)
    return F.coalesce(signed, F.format_string("%.6f", value))


def ply_lines(points: DataFrame, order: str, source: str, frame: str, captured_at: str) -> DataFrame:
    """(section, position, value): header, then one line per point in ``order``."""
    count = points.agg(F.count("*").cast("string").alias("n"))
    header = F.concat(
        F.lit("ply\nformat ascii 1.0\ncomment final point cloud\n"),
        F.lit(f"comment source: {source}\ncomment coordinate_frame: {frame}\ncomment captured_at: {captured_at}\n"),
        F.lit("element vertex "), F.col("n"),
        F.lit("\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header"),
    )
    line = F.concat_ws(" ", *[_number(c) for c in "xyz"], *[F.col(c).cast("string") for c in "rgb"])
    body = points.select(F.lit(1).alias("section"), F.col(order).cast("bigint").alias("position"), line.alias("value"))
    return count.select(F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"), header.alias("value")).unionByName(body)


def obj_lines(vertex: DataFrame, face: DataFrame, source: str, frame: str, captured_at: str) -> DataFrame:
    """(section, position, value): header, ``v`` lines, then 1-based ``f`` lines of the valid faces of one mesh."""
    good = valid_faces(face, vertex)
    counts = vertex.agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("t")).unionByName(good.agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("t")))
    total = counts.agg(F.sum("n").cast("string").alias("n"), F.sum("t").cast("string").alias("t"))
    header = F.concat(
        F.lit(f"# final overlay mesh\n# source: {source}\n# coordinate_frame: {frame}\n# captured_at: {captured_at}\n# vertex_count: "),
        F.col("n"), F.lit("\n# triangle_count: "), F.col("t"), F.lit("\no final_overlay_mesh"),
    )
    v = F.concat_ws(" ", F.lit("v"), *[_number(c) for c in "xyz"])
    f = F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1)
    rows = total.select(F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"), header.alias("value"))
    rows = rows.unionByName(vertex.select(F.lit(1).alias("section"), F.col("vid").cast("bigint").alias("position"), v.alias("value")))
    return rows.unionByName(good.select(F.lit(2).alias("section"), F.col("fid").cast("bigint").alias("position"), f.alias("value")))


def _write_ordered(lines: DataFrame, path: str, force: bool) -> None:
    """Text parts whose names sort in line order: a range sort, never a single task."""
    lines.orderBy("section", "position").select("value").write.mode("overwrite" if force else "errorifexists").text(path)


def write_ply(points: DataFrame, path: str, order: str = "seq", source: str = "fused_depth_pointcloud", frame: str = "map", captured_at: str = "", force: bool = False) -> None:
    """Part files that make one ASCII PLY when joined in name order."""
    _write_ordered(ply_lines(points, order, source, frame, captured_at), path, force)


def write_obj(vertex: DataFrame, face: DataFrame, path: str, source: str = "arkit_scene_reconstruction", frame: str = "map", captured_at: str = "", force: bool = False) -> None:
    """Part files that make one OBJ when joined in name order."""
    _write_ordered(obj_lines(vertex, face, source, frame, captured_at), path, force)


def _sidecar(counts: DataFrame, fields: Mapping[str, Column], metadata: Mapping[str, str]) -> DataFrame:
    named = dict(fields)
    if metadata:
        named["metadata"] = F.struct(*[F.lit(v).alias(k) for k, v in sorted(metadata.items())])
    return counts.select(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(named.items())])).alias("value"))


def pointcloud_metadata(points: DataFrame, source: str, frame: str, captured_at: str, metadata: Mapping[str, str] = {}) -> DataFrame:
    """One JSON text with sorted keys."""
    fields = {
        "schema_version": F.lit(1), "ply_file": F.lit("final_pointcloud.ply"), "source": F.lit(source), "coordinate_frame": F.lit(frame),
        "captured_at": F.lit(captured_at), "point_count": F.col("n"),
    }
    return _sidecar(points.agg(F.count("*").alias("n")), fields, metadata)


def mesh_metadata(vertex: DataFrame, face: DataFrame, source: str, frame: str, captured_at: str, metadata: Mapping[str, str] = {}) -> DataFrame:
    good = valid_faces(face, vertex).agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("t"))
    counts = vertex.agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("t")).unionByName(good).agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    fields = {
        "schema_version": F.lit(1), "obj_file": F.lit("final_overlay_mesh.obj"), "source": F.lit(source), "coordinate_frame": F.lit(frame),
        "captured_at": F.lit(captured_at), "vertex_count": F.col("n"), "triangle_count": F.col("t"),
    }
    return _sidecar(counts, fields, metadata)
