"""Triangle meshes as ``vertex(mesh_id, vid, x, y, z)`` and ``face(mesh_id, fid, a, b, c)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions import camera
from terralog.functions.numeric import finite_or, is_finite, whole_div
from terralog.operators.ordered import BUCKET_ROWS, OrderedRows, key_stream, runs
from terralog.operators.payloads import envelope_base, fit_snapshot, pack_rows
from terralog.session import freeze

MIN_JUMP_M = 0.45
RELATIVE_JUMP = 0.18
MIN_LENGTH_SQUARED = 1e-6


def grid_mesh(
    depth: DataFrame, intrinsics: DataFrame, calibration: DataFrame, step: int = 1, max_triangles: int | None = None,
    min_depth: float = 0.1, max_depth: float | None = None, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mesh over the sampled depth grid of each frame: (vertex, face) with the frame as mesh id.

    Every ``step``-th column and row and the last ones are used.  Each cell gives (UL, LL, UR) and (UR, LL, LR); a
    triangle needs its three depths and a jump within max(0.45, 0.18 of the nearest).  One look left and right along a
    row and one join to the row below yield both triangles, since both stand on one vertical edge of the grid.
    """
    c = F.col
    sized = depth.join(intrinsics, "frame").join(calibration.select("frame", "scale", "offset"), "frame")
    on_grid = ((c("px") % step == 0) | (c("px") == c("depth_w") - 1)) & ((c("py") % step == 0) | (c("py") == c("depth_h") - 1))
    metric = camera.calibrated_depth(c("relative"), c("scale"), c("offset"))
    deep = (c("_d") >= min_depth) if max_depth is None else c("_d").between(min_depth, max_depth)
    point = camera.unproject(c("px"), c("py"), c("_d"), c("fx"), c("fy"), c("cx"), c("cy"), (c("image_w"), c("image_h")), (c("depth_w"), c("depth_h")))
    kept = (
        sized.filter(on_grid & (c("depth_w") > 1) & (c("depth_h") > 1)).withColumn("_d", metric).filter(deep)
        .withColumn("_p", point).filter(c("_p").isNotNull())
        .select("frame", F.ceil(c("px") / step).cast("int").alias("ci"), F.ceil(c("py") / step).cast("int").alias("ri"), "_d", camera.to_map(c("_p"), c("m")).alias("_w"))
    )
    ranked = OrderedRows(kept, ["frame"], ["ri", "ci"], limit).rank("vid").result().withColumn("vid", c("vid") - 1)
    cell = F.struct("ci", "vid", "_d")
    row = Window.partitionBy("frame", "ri").orderBy("ci")
    wide = ranked.select("frame", "ri", "ci", "vid", "_d", F.lag(cell).over(row).alias("_l"), F.lead(cell).over(row).alias("_r"))
    left = F.when(c("_l.ci") == c("ci") - 1, c("_l"))
    right = F.when(c("_r.ci") == c("ci") + 1, c("_r"))
    upper = wide.select("frame", "ri", "ci", F.struct("vid", "_d").alias("u"), right.alias("ur"))
    lower = wide.select("frame", (c("ri") - 1).alias("ri"), "ci", F.struct("vid", "_d").alias("l"), left.alias("ll"))

    def triangle(cell_col: Column, half: int, p: Column, q: Column, r: Column) -> Column:
        low, high = F.least(p["_d"], q["_d"], r["_d"]), F.greatest(p["_d"], q["_d"], r["_d"])
        smooth = p.isNotNull() & q.isNotNull() & r.isNotNull() & (high - low <= F.greatest(F.lit(MIN_JUMP_M), low * F.lit(RELATIVE_JUMP)))
        fields = F.struct(cell_col.alias("cc"), F.lit(half).alias("half"), p["vid"].alias("a"), q["vid"].alias("b"), r["vid"].alias("c"))
        return F.when(smooth, fields)

    both = F.array_compact(F.array(triangle(c("ci"), 0, c("u"), c("l"), c("ur")), triangle(c("ci") - 1, 1, c("u"), c("ll"), c("l"))))
    edges = upper.join(lower, ["frame", "ri", "ci"]).select("frame", "ri", F.explode(both).alias("_t")).select("frame", "ri", "_t.*")
    faces = OrderedRows(edges, ["frame"], ["ri", "cc", "half"], limit).rank("fid").result()
    faces = faces if max_triangles is None else faces.filter(c("fid") <= max_triangles)
    face = faces.select(c("frame").alias("mesh_id"), (c("fid") - 1).alias("fid"), "a", "b", "c")
    used = face.select("mesh_id").distinct()
    vertex = ranked.select(c("frame").alias("mesh_id"), "vid", "_w.*").join(used, "mesh_id", "left_semi")
    return vertex, face


# --- look-ups ----------------------------------------------------------------------------------------------------------


def vertex_counts(vertex: DataFrame) -> DataFrame:
    return vertex.groupBy("mesh_id").agg(F.count("*").alias("vertices"))


def valid_faces(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """Faces whose three indices exist."""
    counted = face.join(vertex_counts(vertex), "mesh_id")
    inside = F.lit(True)
    for corner in "abc":
        inside = inside & (F.col(corner) >= 0) & (F.col(corner) < F.col("vertices"))
    return counted.filter(inside).drop("vertices")


def _corners(face: DataFrame, *more: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(i).alias("corner"), F.col(x).alias("vid")) for i, x in enumerate("abc")])
    return face.select("mesh_id", "fid", *more, F.explode(listed).alias("_c")).select("mesh_id", "fid", *more, "_c.*")


def face_vertices(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """Each face ``(mesh_id, fid, a, b, c)`` with its three points ``p0, p1, p2``; a face with a missing vertex is left out."""
    # one join per corner: a face travels three times as one row, not as three rows and once more to be put together
    wide = face.select("mesh_id", "fid", *"abc")
    at = vertex.select("mesh_id", "vid", "x", "y", "z")
    for i, corner in enumerate("abc"):
        wide = wide.join(at.withColumnsRenamed({"vid": corner, **{v: f"_{v}{i}" for v in "xyz"}}), ["mesh_id", corner])
    points = [F.struct(*[F.col(f"_{v}{i}").alias(v) for v in "xyz"]).alias(f"p{i}") for i in range(3)]
    return wide.select("mesh_id", "fid", *"abc", *points)


def mesh_stats(face: DataFrame, vertex: DataFrame, published: DataFrame | None = None, key: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session: meshes, vertices, triangles; with ``published`` faces also their number and the truncated flag."""
    meshes = vertex.groupBy(*key).agg(F.count("*").alias("vertices"), F.count_distinct("mesh_id").alias("meshes"))
    triangles = face.groupBy(*key).agg(F.count("*").alias("triangles"))
    out = meshes.join(triangles, list(key), "left")
    if published is not None:
        out = out.join(published.groupBy(*key).agg(F.count("*").alias("published_triangles")), list(key), "left")
        out = out.fillna(0, ["published_triangles"]).withColumn("is_truncated", F.col("published_triangles") < F.coalesce("triangles", F.lit(0)))
    return out.fillna(0, ["triangles"])


def _difference(p: Column, q: Column) -> dict[str, Column]:
    return {c: p[c] - q[c] for c in "xyz"}


def _cross(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}


def _square(v: dict[str, Column]) -> Column:
    return v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]


def _normalized(v: dict[str, Column], fallback: tuple[float, float, float]) -> dict[str, Column]:
    length = F.sqrt(_square(v))
    usable = is_finite(length) & (length > F.lit(1e-6))
    return {c: F.when(usable, v[c] / length).otherwise(F.lit(f)) for c, f in zip("xyz", fallback)}


def vertex_normals(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """Unit sum of the unit normals of a vertex's faces; (0, 1, 0) where there is none."""
    n = _cross(_difference(F.col("p1"), F.col("p0")), _difference(F.col("p2"), F.col("p0")))
    size = _square(n)
    flat = face_vertices(face, vertex).withColumn("_n", F.when(size > MIN_LENGTH_SQUARED, F.struct(*[(n[c] / F.sqrt(size)).alias(c) for c in "xyz"])))
    units = flat.filter(F.col("_n").isNotNull()).select("mesh_id", "fid", "a", "b", "c", "_n")
    sums = _corners(units, "_n").groupBy("mesh_id", "vid").agg(*[F.sum(f"_n.{c}").alias(f"_s{c}") for c in "xyz"])
    joined = vertex.join(sums, ["mesh_id", "vid"], "left")
    total = {c: F.coalesce(F.col(f"_s{c}"), F.lit(0.0)) for c in "xyz"}
    length = _square(total)
    out = {f"n{c}": F.when(length > MIN_LENGTH_SQUARED, total[c] / F.sqrt(length)).otherwise(F.lit(f)) for c, f in zip("xyz", (0.0, 1.0, 0.0))}
    return joined.select("mesh_id", "vid", *[v.alias(k) for k, v in out.items()])


def surfel_triangles(surfels: DataFrame, key: Sequence[str] = ("session_id", "vx", "vy", "vz")) -> DataFrame:
    """Three corners per surfel in its tangent plane; non-finite surfels are left out."""
    c = F.col
    finite = surfels.filter(is_finite(c("x")) & is_finite(c("y")) & is_finite(c("z")))
    n = _normalized({a: c(f"n{a}") for a in "xyz"}, (0.0, 1.0, 0.0))
    named = finite.withColumn("_n", F.struct(*[n[a].alias(a) for a in "xyz"]))
    n = {a: c(f"_n.{a}") for a in "xyz"}
    upright = F.abs(n["y"]) < 0.9
    helper = {"x": F.when(upright, 0.0).otherwise(1.0), "y": F.when(upright, 1.0).otherwise(0.0), "z": F.lit(0.0)}
    t = _normalized(_cross(helper, n), (1.0, 0.0, 0.0))
    named = named.withColumn("_t", F.struct(*[t[a].alias(a) for a in "xyz"]))
    t = {a: c(f"_t.{a}") for a in "xyz"}
    b = _normalized(_cross(n, t), (0.0, 0.0, 1.0))
    named = named.withColumn("_b", F.struct(*[b[a].alias(a) for a in "xyz"]))
    b = {a: c(f"_b.{a}") for a in "xyz"}
    radius = F.least(F.greatest(c("radius"), F.lit(0.008)), F.lit(0.045))

    def corner(i: int, along: float, across: float) -> Column:
        return F.struct(F.lit(i).alias("corner"), *[(c(a) + t[a] * radius * F.lit(along) + b[a] * radius * F.lit(across)).alias(f"p{a}") for a in "xyz"])

    corners = F.array(corner(0, 1.0, 0.0), corner(1, -0.5, 0.86), corner(2, -0.5, -0.86))
    return named.select(*key, F.explode(corners).alias("_k"), "r", "g", "b").select(*key, "_k.corner", c("_k.px").alias("x"), c("_k.py").alias("y"), c("_k.pz").alias("z"), "r", "g", "b")


# --- snapshots ---------------------------------------------------------------------------------------------------------


def _in_snapshot(face: DataFrame, meshes: DataFrame) -> DataFrame:
    return face.join(meshes.select("snapshot_id", "mesh_id", "mesh_order"), "mesh_id")


def triangle_budget(face: DataFrame, vertex: DataFrame, meshes: DataFrame, n: int | None, limit: int | None = None) -> DataFrame:
    """First ``n`` valid faces (None: all) per snapshot in mesh and face order, as ``tri`` from 1; bad faces use no budget."""
    rows = _in_snapshot(valid_faces(face, vertex), meshes)
    ranked = OrderedRows(rows, ["snapshot_id"], ["mesh_order", "fid"], limit).rank("tri").result()
    return ranked if n is None else ranked.filter(F.col("tri") <= n)


def remap_vertices(budgeted: DataFrame, limit: int | None = None, bound: int | None = None) -> DataFrame:
    """Dense vertex ids per snapshot in order of first use: (snapshot_id, mesh_id, vid, first, gid)."""
    corners = _corners(budgeted, "snapshot_id", "tri")
    first = corners.groupBy("snapshot_id", "mesh_id", "vid").agg(F.min((F.col("tri") - 1) * 3 + F.col("corner")).alias("first"))
    return OrderedRows(first, ["snapshot_id"], ["first"], limit, bound).rank("gid").result().withColumn("gid", F.col("gid") - 1)


def remapped_faces(budgeted: DataFrame, remap: DataFrame) -> DataFrame:
    """Faces in the dense ids: (snapshot_id, tri, a, b, c)."""
    corners = _corners(budgeted, "snapshot_id", "tri").join(remap.select("snapshot_id", "mesh_id", "vid", "gid"), ["snapshot_id", "mesh_id", "vid"])
    points = [F.max(F.when(F.col("corner") == i, F.col("gid"))).alias(x) for i, x in enumerate("abc")]
    return corners.groupBy("snapshot_id", "tri").agg(*points)


def numbered_faces(face: DataFrame, vertex: DataFrame, meshes: DataFrame, n: int | None) -> DataFrame:
    """``triangle_budget``, ``remap_vertices`` and ``remapped_faces`` in one pass: (snapshot_id, mesh_id, tri, and per corner
    x of a, b, c: x its ``vid``, gx its dense id, nx whether it is its vertex's first use).

    A stream of each snapshot's faces in mesh and face order: one shuffle and one sort of faces, and no row per corner.
    Vertices belong to a mesh, so the state is two counts and the ids given to the vertices of one mesh.
    """
    rows = _in_snapshot(valid_faces(face, vertex), meshes).select("snapshot_id", "mesh_order", "mesh_id", "fid", *[F.col(x).cast("bigint").alias(x) for x in "abc"])
    corner = [(x, T.LongType()) for x in "abc"] + [(f"g{x}", T.LongType()) for x in "abc"] + [(f"n{x}", T.BooleanType()) for x in "abc"]
    schema = T.StructType([rows.schema["snapshot_id"], rows.schema["mesh_id"], *[T.StructField(c, t) for c, t in [("tri", T.LongType()), *corner]]])

    def number(state, batch: pa.RecordBatch):
        faces, used, mesh, ids = state or (0, 0, None, np.zeros(0, np.int64))
        batch = batch if n is None else batch.slice(0, max(0, n - faces))
        if not batch.num_rows:
            return (faces, used, mesh, ids), None
        vids = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in "abc"], axis=1)
        dense, new = np.empty(vids.shape, np.int64), np.zeros(vids.size, bool)
        cuts = runs(batch, ["mesh_id"])
        for low, high in zip(cuts, cuts[1:]):
            if (this := (batch.column("mesh_id")[low].as_py(),)) != mesh:
                mesh, ids = this, np.zeros(0, np.int64)
            v = vids[low:high].ravel()
            if v.max() >= len(ids):
                ids = np.append(ids, np.full(max(int(v.max()) + 1, 2 * len(ids)) - len(ids), -1))
            fresh = np.flatnonzero(ids[v] < 0)
            at = fresh[np.sort(np.unique(v[fresh], return_index=True)[1])]
            ids[v[at]] = used + np.arange(len(at))
            new[3 * low + at] = True
            used += len(at)
            dense[low:high] = ids[vids[low:high]]
        tri = faces + 1 + np.arange(len(vids))
        columns = [*vids.T, *dense.T, *new.reshape(-1, 3).T]
        made = [batch.column("snapshot_id"), batch.column("mesh_id"), pa.array(tri), *[pa.array(np.ascontiguousarray(c)) for c in columns]]
        return (faces + len(vids), used, mesh, ids), pa.RecordBatch.from_arrays(made, schema.names)

    return key_stream(rows, ["snapshot_id"], ["mesh_order", "mesh_id", "fid"], number, schema)


def source_counts(face: DataFrame, vertex: DataFrame, meshes: DataFrame) -> DataFrame:
    per_mesh = vertex_counts(vertex).join(face.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id", "full")
    return meshes.join(per_mesh, "mesh_id", "left").groupBy("snapshot_id").agg(
        F.count("*").alias("anchor_count"),
        F.coalesce(F.sum("vertices"), F.lit(0)).alias("original_vertex_count"),
        F.coalesce(F.sum("faces"), F.lit(0)).alias("original_triangle_count"),
    )


def collect_snapshot(
    face: DataFrame, vertex: DataFrame, meshes: DataFrame, max_points: int | None = None, max_bytes: int | None = None,
    topic: str = "/mapping/mesh_snapshot", limit: int | None = None,
) -> DataFrame:
    """One packed message row per snapshot; ``max_points`` (three per triangle) and ``max_bytes`` of the envelope cut it.
    The row tells how many vertices and triangles there were and whether some were left out.

    ``meshes`` is (snapshot_id, mesh_id, mesh_order, m) with the 4x4 transform to the map frame.
    """
    # what is left of a snapshot is read several times below, so it is written once
    chosen = freeze(numbered_faces(face, vertex, meshes, max_points and max_points // 3))
    totals = source_counts(face, vertex, meshes)
    header = F.struct(F.lit("map").alias("frame_id"))
    sized = totals.withColumn(
        "base_bytes",
        envelope_base(topic, header, F.col("snapshot_id").cast("string"), "arkit_mesh", "map", F.col("anchor_count"), F.col("original_vertex_count"), F.col("original_triangle_count")),
    )
    if max_bytes is not None:
        new = sum((F.col(f"n{x}").cast("bigint") for x in "abc"), F.lit(0))
        fitted = fit_snapshot(chosen.select("snapshot_id", "tri", new.alias("new_vertices")), sized, max_bytes, limit)
        chosen = chosen.join(fitted, "snapshot_id").filter(F.col("tri") <= F.col("fitted")).drop("fitted")
    used = F.array(*[F.struct(F.col(x).alias("vid"), F.col(f"g{x}").alias("gid"), F.col(f"n{x}").alias("_new")) for x in "abc"])
    remap = chosen.select("snapshot_id", "mesh_id", F.inline(used)).filter("_new").drop("_new")
    placed = remap.join(vertex, ["mesh_id", "vid"]).join(meshes.select("snapshot_id", "mesh_id", "m"), ["snapshot_id", "mesh_id"])
    world = camera.to_map(F.struct("x", "y", "z"), F.col("m"))
    points = placed.select("snapshot_id", "gid", world.alias("_w")).select("snapshot_id", "gid", *[finite_or(F.col(f"_w.{c}"), 0.0).cast("float").alias(c) for c in "xyz"])
    indexed = chosen.select("snapshot_id", (F.col("tri") - 1).alias("_i"), *[F.col(f"g{x}").alias(x) for x in "abc"])
    vertices = pack_rows(points, ["snapshot_id"], "gid", [(c, "<f4") for c in "xyz"]).select("snapshot_id", F.col("rows").alias("vertex_count"), F.col("data").alias("vertex_data"))
    triangles = pack_rows(indexed, ["snapshot_id"], "_i", [(c, "<u4") for c in "abc"]).select("snapshot_id", F.col("rows").alias("triangle_count"), F.col("data").alias("index_data"))
    out = sized.join(vertices, "snapshot_id", "left").join(triangles, "snapshot_id", "left")
    out = out.fillna(0, ["vertex_count", "triangle_count"]).fillna("", ["vertex_data", "index_data"])
    truncated = F.col("triangle_count") < F.col("original_triangle_count")
    published = (
        F.col("base_bytes") + F.when(truncated, 4).otherwise(5) + F.length(F.col("triangle_count").cast("string"))
        + F.length(F.col("vertex_count").cast("string")) + F.length("vertex_data") + F.length("index_data")
    )
    return out.withColumns({"is_truncated": truncated, "published_payload_bytes": published.cast("bigint")}).drop("base_bytes")


def merge_meshes(face: DataFrame, vertex: DataFrame, meshes: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All meshes of a snapshot as one: (vertex, face).  Vertices are moved to the map frame and numbered on; a bad
    index is dropped from the index list, and the list is then read in threes again."""
    counts = vertex_counts(vertex).join(face.select("mesh_id").distinct(), "mesh_id", "left_semi")
    usable = meshes.join(counts, "mesh_id")
    # good corners up to each face of its mesh, counted in stretches of faces; a mesh is then one row of its totals
    listed = F.array(*[F.col(x) for x in "abc"])
    inside = F.filter(listed, lambda v: (v >= 0) & (v < F.col("vertices"))).alias("_good")
    sized = face.join(counts, "mesh_id").select("mesh_id", "fid", inside)
    walked = OrderedRows(sized, ["mesh_id"], ["fid"], limit, width=BUCKET_ROWS).cumulative("_i", F.size("_good").cast("bigint")).result()
    per_mesh = sized.groupBy("mesh_id").agg(F.sum(F.size("_good")).alias("_corners"))
    ends = OrderedRows(usable.join(per_mesh, "mesh_id"), ["snapshot_id"], ["mesh_order"], limit)
    ends = ends.cumulative("_o", F.col("vertices")).cumulative("_c", F.col("_corners")).result()
    offsets = ends.withColumns({"_o": F.col("_o") - F.col("vertices"), "_c": F.col("_c") - F.col("_corners")})
    moved = vertex.join(offsets.select("snapshot_id", "mesh_id", "m", "_o"), "mesh_id")
    world = camera.to_map(F.struct("x", "y", "z"), F.col("m"))
    out_vertex = moved.select("snapshot_id", (F.col("vid") + F.col("_o")).alias("vid"), world.alias("_w")).select("snapshot_id", "vid", "_w.*")
    # a face's good corners are neighbours in the list: they fall into two new faces at most, which are put together by their place
    placed = walked.join(offsets.select("snapshot_id", "mesh_id", "_o", "_c"), "mesh_id").filter(F.size("_good") > 0)
    placed = placed.select("snapshot_id", "_o", "_good", (F.col("_c") + F.col("_i") - F.size("_good")).alias("_p"))
    first = whole_div(F.col("_p"), 3)

    def corner(fid: Column, k: int) -> Column:
        at = fid * 3 + k - F.col("_p")
        return F.when((at >= 0) & (at < F.size("_good")), F.get("_good", at.cast("int")) + F.col("_o"))

    parts = F.sequence(first, whole_div(F.col("_p") + F.size("_good") - 1, 3))
    rows = placed.select("*", F.explode(parts).alias("fid"))
    rows = rows.select("snapshot_id", "fid", *[corner(F.col("fid"), k).alias(x) for k, x in enumerate("abc")])
    out_face = rows.groupBy("snapshot_id", "fid").agg(*[F.max(x).alias(x) for x in "abc"]).filter("a is not null and b is not null and c is not null")
    return out_vertex, out_face


def triangle_soup(face: DataFrame, vertex: DataFrame, meshes: DataFrame, max_points: int, limit: int | None = None) -> DataFrame:
    """Three map-frame points per face.  Here a mesh takes its share of the remaining budget before bad faces are
    skipped, so bad faces do use the share of their own mesh.

    What a mesh takes depends on the good faces that the meshes before it took.  A mesh is one row of its number of
    faces and the places of its bad ones, which tells how many good faces are among the first n; the budget is folded over
    the meshes of a snapshot, and faces meet the share of their mesh afterwards.
    """
    counted = face.join(vertex_counts(vertex), "mesh_id", "left")
    inside = F.lit(True)
    for corner in "abc":
        inside = inside & (F.col(corner) >= 0) & (F.col(corner) < F.coalesce("vertices", F.lit(0)))
    rows = _in_snapshot(counted, meshes).withColumn("_ok", inside).select("snapshot_id", "mesh_order", "mesh_id", "fid", "_ok")
    # no mesh can take more than the whole budget, so the rest of its faces need not take part
    first = OrderedRows(rows, ["snapshot_id", "mesh_order", "mesh_id"], ["fid"], limit).rank("_f").result()
    ranked = first.filter(F.col("_f") <= max(0, max_points // 3))
    per_mesh = ranked.groupBy("snapshot_id", "mesh_order", "mesh_id").agg(
        F.count("*").alias("faces"), F.collect_list(F.when(~F.col("_ok"), F.col("_f"))).alias("bad")
    )
    listed = F.array_sort(F.collect_list(F.struct("mesh_order", "mesh_id", "faces", "bad")))
    kind = "struct<points:bigint,shares:array<bigint>>"
    start = F.struct(F.lit(0).alias("points"), F.array().alias("shares")).cast(kind)

    def take(state: Column, mesh: Column) -> Column:
        share = whole_div(F.greatest(F.lit(max_points) - state["points"], F.lit(0)), 3)
        taken = F.least(share, mesh["faces"]) - F.size(F.filter(mesh["bad"], lambda f: f <= share))
        return F.struct((state["points"] + taken * 3).alias("points"), F.concat(state["shares"], F.array(share)).alias("shares")).cast(kind)

    folded = per_mesh.groupBy("snapshot_id").agg(listed.alias("_meshes"))
    shares = folded.select(
        "snapshot_id", F.explode(F.arrays_zip(F.col("_meshes.mesh_order").alias("mesh_order"), F.col("_meshes.mesh_id").alias("mesh_id"), F.aggregate("_meshes", start, take)["shares"].alias("share"))).alias("_m")
    ).select("snapshot_id", "_m.*")
    chosen = ranked.join(shares, ["snapshot_id", "mesh_order", "mesh_id"]).filter("_ok AND _f <= share").select("snapshot_id", "mesh_order", "mesh_id", "fid")
    points = face_vertices(face.join(chosen.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_semi"), vertex)
    placed = chosen.join(points.drop("a", "b", "c"), ["mesh_id", "fid"]).join(meshes.select("mesh_id", "m"), "mesh_id")
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), camera.to_map(F.col(f"p{i}"), F.col("m")).alias("p")) for i in range(3)])
    return placed.select("snapshot_id", "mesh_order", "mesh_id", "fid", F.explode(corners).alias("_k")).select(
        "snapshot_id", "mesh_order", "mesh_id", "fid", "_k.corner", "_k.p.*"
    )
