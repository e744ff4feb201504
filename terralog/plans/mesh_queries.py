"""Queries over triangle meshes: look-ups, normals, budgets, snapshots, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.numeric import whole_div
from terralog.operators import calibration, mesh, payloads
from terralog.plans.registry import query, sql
from terralog.plans.views import Tables
from terralog.sources import artifacts


def _near(value: Column, scale: float = 1e5) -> Column:
    return F.floor(value * F.lit(scale) + F.lit(0.371931)).cast("bigint")


def _qn(expression: str, scale: str = "1e5") -> str:
    return f"CAST(floor(({expression}) * {scale} + 0.371931e0) AS BIGINT)"


def _meshes(vertex: DataFrame, per_snapshot: int | None = 16) -> DataFrame:
    """Sixteen meshes in a row form a snapshot (or all of them one); a quarter turn and a shift place each in the map."""
    i = F.col("mesh_id")
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(zero, zero, one, (i % 5).cast("double"), zero, one, zero, F.lit(2.0), -one, zero, zero, F.lit(3.0), zero, zero, zero, one)
    snapshot = whole_div(i, per_snapshot) if per_snapshot else F.lit(0).cast("bigint")
    return vertex.select("mesh_id").distinct().select(snapshot.alias("snapshot_id"), "mesh_id", i.alias("mesh_order"), m.alias("m"))


_VALID = "(SELECT f.*, n FROM S_face f JOIN (SELECT mesh_id, count(*) AS n FROM S_vertex GROUP BY mesh_id) USING (mesh_id) WHERE a >= 0 AND b < n AND c < n AND a < n)"
_CORNERS = f"(SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([a, b, c]) AS vid FROM {_VALID})"


@query("H9", sql(f"SELECT mesh_id, fid, a, b, c FROM {_VALID}", "S_vertex", "S_face"))
def valid_faces(t: Tables) -> DataFrame:
    vertex = t.vertices()
    return mesh.valid_faces(t.faces(vertex), vertex)


@query("C9", sql(f"""
    WITH P AS MATERIALIZED (SELECT mesh_id, vid, x, y, z FROM S_vertex), F AS MATERIALIZED (SELECT mesh_id, fid, a, b, c FROM S_face),
    K AS (SELECT mesh_id, fid, corner, x, y, z FROM (SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([a, b, c]) AS vid FROM F) JOIN P USING (mesh_id, vid))
    SELECT mesh_id, fid, {", ".join(f"{_qn(f'max({c}) FILTER (WHERE corner = {i})')} AS {c}{i}" for i in range(3) for c in "xyz")} FROM K GROUP BY ALL HAVING count(*) = 3""", "S_vertex", "S_face"))
def face_points(t: Tables) -> DataFrame:
    vertex = t.vertices()
    return mesh.face_vertices(t.faces(vertex), vertex).select("mesh_id", "fid", *[_near(F.col(f"p{i}.{c}")).alias(f"{c}{i}") for i in range(3) for c in "xyz"])


_FLAT = f"""
    SELECT f.mesh_id, f.fid, a, b, c, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS nx, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS ny,
           (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS nz FROM {_VALID} f
    JOIN S_vertex p ON p.mesh_id = f.mesh_id AND p.vid = f.a JOIN S_vertex q ON q.mesh_id = f.mesh_id AND q.vid = f.b JOIN S_vertex r ON r.mesh_id = f.mesh_id AND r.vid = f.c"""


@query("H12", sql(f"""
    SELECT mesh_id, vid, {_qn('CASE WHEN l > 1e-6 THEN sx / sqrt(l) ELSE 0e0 END')} AS nx, {_qn('CASE WHEN l > 1e-6 THEN sy / sqrt(l) ELSE 1e0 END')} AS ny, {_qn('CASE WHEN l > 1e-6 THEN sz / sqrt(l) ELSE 0e0 END')} AS nz
    FROM (SELECT v.mesh_id, v.vid, sx, sy, sz, coalesce(sx * sx + sy * sy + sz * sz, 0e0) AS l FROM S_vertex v LEFT JOIN (
        SELECT mesh_id, vid, sum(nx / sqrt(s)) AS sx, sum(ny / sqrt(s)) AS sy, sum(nz / sqrt(s)) AS sz
        FROM (SELECT *, nx * nx + ny * ny + nz * nz AS s, unnest([a, b, c]) AS vid FROM ({_FLAT})) WHERE s > 1e-6 GROUP BY mesh_id, vid) USING (mesh_id, vid))""", "S_vertex", "S_face"))
def vertex_normals(t: Tables) -> DataFrame:
    vertex = t.vertices()
    return mesh.vertex_normals(t.faces(vertex), vertex).select("mesh_id", "vid", *[_near(F.col(c)).alias(c) for c in ("nx", "ny", "nz")])


@query("D12", sql("""
    SELECT s.session_id, vertices, meshes, triangles, valid AS published_triangles, valid < triangles AS is_truncated
    FROM (SELECT mesh_id % 8 AS session_id, count(*) AS vertices, count(DISTINCT mesh_id) AS meshes FROM S_vertex GROUP BY ALL) s
    JOIN (SELECT mesh_id % 8 AS session_id, count(*) AS triangles FROM S_face GROUP BY ALL) USING (session_id)
    JOIN (SELECT mesh_id % 8 AS session_id, count(*) AS valid FROM {v} GROUP BY ALL) USING (session_id)""".format(v=_VALID), "S_vertex", "S_face"))
def mesh_stats(t: Tables) -> DataFrame:
    vertex = t.vertices()
    face = t.faces(vertex)
    session = {"session_id": F.col("mesh_id") % 8}
    return mesh.mesh_stats(face.withColumns(session), vertex.withColumns(session), mesh.valid_faces(face, vertex).withColumns(session))


_BUDGET = f"(SELECT * FROM (SELECT *, mesh_id // 16 AS snapshot_id, row_number() OVER (PARTITION BY mesh_id // 16 ORDER BY mesh_id, fid) AS tri FROM {_VALID}) WHERE tri <= 1500)"
_REMAP = f"""(SELECT snapshot_id, mesh_id, vid, first, row_number() OVER (PARTITION BY snapshot_id ORDER BY first) - 1 AS gid FROM (
    SELECT snapshot_id, mesh_id, vid, min((tri - 1) * 3 + corner) AS first FROM (SELECT *, unnest([0, 1, 2]) AS corner, unnest([a, b, c]) AS vid FROM {_BUDGET}) GROUP BY ALL))"""


@query("E12", sql(f"SELECT snapshot_id, mesh_id, fid, tri FROM {_BUDGET}", "S_vertex", "S_face"))
def budgeted_triangles(t: Tables) -> DataFrame:
    vertex = t.vertices()
    return mesh.triangle_budget(t.faces(vertex), vertex, _meshes(vertex), 1500).select("snapshot_id", "mesh_id", "fid", "tri")


@query("E11", sql(f"SELECT snapshot_id, mesh_id, vid, first, gid FROM {_REMAP}", "S_vertex", "S_face"))
def remapped_vertices(t: Tables) -> DataFrame:
    vertex = t.vertices()
    return mesh.remap_vertices(mesh.triangle_budget(t.faces(vertex), vertex, _meshes(vertex), 1500))


@query("H6", sql(f"""
    SELECT snapshot_id, anchor_count, original_vertex_count, original_triangle_count, vertex_count, triangle_count, triangle_count < original_triangle_count AS is_truncated,
           CAST((12 * vertex_count + 2) // 3 AS BIGINT) * 4 AS vertex_text, CAST((12 * triangle_count + 2) // 3 AS BIGINT) * 4 AS index_text
    FROM (SELECT mesh_id // 16 AS snapshot_id, count(*) AS original_vertex_count, count(DISTINCT mesh_id) AS anchor_count FROM S_vertex GROUP BY ALL)
    JOIN (SELECT mesh_id // 16 AS snapshot_id, count(*) AS original_triangle_count FROM S_face GROUP BY ALL) USING (snapshot_id)
    JOIN (SELECT snapshot_id, count(*) AS vertex_count FROM {_REMAP} GROUP BY ALL) USING (snapshot_id)
    JOIN (SELECT snapshot_id, count(*) AS triangle_count FROM {_BUDGET} GROUP BY ALL) USING (snapshot_id)""", "S_vertex", "S_face"))
def packed_snapshots(t: Tables) -> DataFrame:
    vertex = t.vertices()
    packed = mesh.collect_snapshot(t.faces(vertex), vertex, _meshes(vertex), 4500)
    return packed.select(
        "snapshot_id", "anchor_count", "original_vertex_count", "original_triangle_count", "vertex_count", "triangle_count", "is_truncated",
        F.length("vertex_data").cast("bigint").alias("vertex_text"), F.length("index_data").cast("bigint").alias("index_text"),
    )


def _messages(t: Tables) -> DataFrame:
    vertex = t.vertices()
    packed = mesh.collect_snapshot(t.faces(vertex), vertex, _meshes(vertex), 4500)
    return packed.withColumns({"session_id": F.lit("s"), "stamp_ns": F.col("snapshot_id")})


@query("H5 H6", sql(f"""
    SELECT snapshot_id, gid AS vid, {_qn('CAST(CAST(z + mesh_id % 5 AS FLOAT) AS DOUBLE)')} AS x, {_qn('CAST(CAST(y + 2e0 AS FLOAT) AS DOUBLE)')} AS y, {_qn('CAST(CAST(3e0 - x AS FLOAT) AS DOUBLE)')} AS z
    FROM {_REMAP} JOIN S_vertex USING (mesh_id, vid)""", "S_vertex", "S_face"))
def snapshot_vertices(t: Tables) -> DataFrame:
    vertex, _ = payloads.explode_snapshot(_messages(t))
    return vertex.select("snapshot_id", "vid", *[_near(F.col(c)).alias(c) for c in "xyz"])


@query("H5 H6", sql(f"""
    SELECT snapshot_id, tri - 1 AS fid, max(gid) FILTER (WHERE corner = 0) AS a, max(gid) FILTER (WHERE corner = 1) AS b, max(gid) FILTER (WHERE corner = 2) AS c
    FROM (SELECT snapshot_id, mesh_id, tri, unnest([0, 1, 2]) AS corner, unnest([a, b, c]) AS vid FROM {_BUDGET}) JOIN {_REMAP} USING (snapshot_id, mesh_id, vid) GROUP BY snapshot_id, tri""", "S_vertex", "S_face"))
def snapshot_faces(t: Tables) -> DataFrame:
    _, face = payloads.explode_snapshot(_messages(t))
    return face.select("snapshot_id", "fid", "a", "b", "c")


# Fixed text of a mesh envelope without its blobs, its two counts and its truncated flag; the counts and the name vary.
_ENVELOPE = (
    """'{"msg":{"anchor_count":' || anchors || ',"compression":"mesh_snapshot_binary_base64","frame_id":"map","header":{"frame_id":"map"},"index_data":"","index_encoding":"uint32_le_base64","""
    """"index_stride_bytes":4,"metadata_json":"{}","original_payload_bytes":0,"original_triangle_count":' || triangles || ',"original_vertex_count":' || vertices || ',"published_payload_bytes":0,"""
    """"schema_version":1,"snapshot_id":"' || name || '","source":"' || source || '","vertex_data":"","vertex_encoding":"float32_xyz_le_base64","vertex_stride_bytes":12},"op":"publish","topic":"/mapping/mesh_snapshot"}'"""
)
_BASE = f"strlen({_ENVELOPE}) + {len('\"is_truncated\":,\"triangle_count\":,\"vertex_count\":,')}"
_WIDE = _REMAP.replace("<= 1500", "<= 4000")


@query("H7", sql(f"""
    WITH totals AS (
        SELECT mesh_id // 16 AS snapshot_id, (mesh_id // 16)::VARCHAR AS name, 'arkit_mesh' AS source, count(*) AS vertices, count(DISTINCT mesh_id) AS anchors,
               (SELECT count(*) FROM S_face f WHERE f.mesh_id // 16 = v.mesh_id // 16) AS triangles FROM S_vertex v GROUP BY ALL),
    used AS (SELECT snapshot_id, first // 3 + 1 AS tri, count(*) AS new FROM {_WIDE} GROUP BY ALL),
    prefixes AS (
        SELECT snapshot_id, tri, CAST(sum(coalesce(new, 0)) OVER (PARTITION BY snapshot_id ORDER BY tri) AS BIGINT) AS seen
        FROM (SELECT snapshot_id, tri FROM {_BUDGET.replace("<= 1500", "<= 4000")}) LEFT JOIN used USING (snapshot_id, tri)),
    sized AS (
        SELECT snapshot_id, tri, seen, triangles, {_BASE} + CASE WHEN tri < triangles THEN 4 ELSE 5 END + strlen(tri::VARCHAR) + strlen(seen::VARCHAR) + (12 * seen + 2) // 3 * 4 + (12 * tri + 2) // 3 * 4 AS bytes
        FROM prefixes JOIN totals USING (snapshot_id))
    SELECT snapshot_id, max(seen) AS vertex_count, max(tri) AS triangle_count, max(tri) < any_value(triangles) AS is_truncated, CAST(arg_max(bytes, tri) AS BIGINT) AS published_payload_bytes
    FROM sized WHERE bytes <= 16000 GROUP BY snapshot_id""", "S_vertex", "S_face"))
def fitted_snapshots(t: Tables) -> DataFrame:
    vertex = t.vertices()
    packed = mesh.collect_snapshot(t.faces(vertex), vertex, _meshes(vertex), 12_000, 16_000)
    return packed.select("snapshot_id", "vertex_count", "triangle_count", "is_truncated", "published_payload_bytes")


@query("H7", f"""
    WITH lists AS (SELECT l_orderkey // 64 AS mesh_id, (l_orderkey // 64)::VARCHAR AS name, 's' AS source, 1 AS anchors, count(*) // 3 * 3 AS vertices, count(*) // 3 AS triangles FROM lineitem GROUP BY ALL),
    sized AS (SELECT *, {_BASE} AS base FROM lists),
    tried AS (SELECT mesh_id, vertices, k, base + CASE WHEN k < triangles THEN 4 ELSE 5 END + 64 * k + strlen(k::VARCHAR) + strlen((3 * k)::VARCHAR) AS bytes FROM (SELECT *, unnest(range(0, triangles + 1)) AS k FROM sized))
    SELECT mesh_id, vertices AS points, CAST(coalesce(max(3 * k) FILTER (WHERE bytes <= 5000), 0) AS BIGINT) AS fitted FROM tried GROUP BY ALL""")
def fitted_point_lists(t: Tables) -> DataFrame:
    """Lists that fit stay as they are; the others are cut to the most triangles that fit."""
    lists = t.table("lineitem").groupBy(whole_div(F.col("l_orderkey"), 64).alias("mesh_id")).agg((whole_div(F.count("*"), 3) * 3).alias("points"))
    base = payloads.envelope_base("/mapping/mesh_snapshot", F.struct(F.lit("map").alias("frame_id")), F.col("mesh_id").cast("string"), "s", "map", F.lit(1), F.col("points"), whole_div(F.col("points"), 3))
    return payloads.fit_points(lists.withColumn("base_bytes", base), 5_000).select("mesh_id", "points", "fitted")


@query("H8", sql(f"""
    WITH p AS MATERIALIZED (
        SELECT mesh_id // 16 AS message_id, mesh_id % 16 AS marker, vid AS position, count(*) OVER (PARTITION BY mesh_id) AS n,
               strlen('{{"x":' || {_qn('x', '1e3')} || ',"y":' || {_qn('y', '1e3')} || ',"z":' || {_qn('z', '1e3')} || '}}') AS bytes FROM S_vertex),
    s AS (SELECT *, sum(bytes + CASE WHEN position > 0 THEN 1 ELSE 180 + CASE WHEN marker > 0 THEN 1 ELSE 0 END END) OVER (PARTITION BY message_id ORDER BY marker, position) AS total FROM p),
    k AS (SELECT message_id, max((marker, position)) AS last FROM s WHERE ((position + 1) % 3 = 0 OR position + 1 = n) AND total + 64 <= 40000 GROUP BY message_id)
    SELECT message_id, marker, CASE WHEN marker = last[1] THEN last[2] + 1 ELSE n END AS kept FROM (SELECT DISTINCT message_id, marker, n FROM p) JOIN k USING (message_id) WHERE marker <= last[1]""", "S_vertex"))
def fitted_markers(t: Tables) -> DataFrame:
    """One marker per mesh, sixteen per message; points as JSON text in whole millimetres."""
    vertex = t.vertices()
    point = F.octet_length(F.to_json(F.struct(*[_near(F.col(c), 1e3).alias(c) for c in "xyz"]))).cast("bigint")
    rows = vertex.select(whole_div(F.col("mesh_id"), 16).alias("message_id"), (F.col("mesh_id") % 16).alias("marker"), F.col("vid").alias("position"), point.alias("point_bytes"), F.lit(180).cast("bigint").alias("marker_bytes"))
    return payloads.fit_markers(rows, 64, 40_000)


_OFFSETS = "(SELECT mesh_id, n, CAST(coalesce(sum(n) OVER (ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM (SELECT mesh_id, count(*) AS n FROM S_vertex GROUP BY mesh_id))"
_FLATTENED = f"""(SELECT (i - 1) // 3 AS fid, (i - 1) % 3 AS k, v FROM (
    SELECT vid + o AS v, row_number() OVER (ORDER BY mesh_id, fid, corner) AS i FROM (SELECT mesh_id, fid, unnest([0, 1, 2]) AS corner, unnest([a, b, c]) AS vid FROM S_face) JOIN {_OFFSETS} USING (mesh_id) WHERE vid >= 0 AND vid < n))"""
_MERGED_FACES = f"(SELECT fid, max(v) FILTER (WHERE k = 0) AS a, max(v) FILTER (WHERE k = 1) AS b, max(v) FILTER (WHERE k = 2) AS c FROM {_FLATTENED} GROUP BY fid HAVING count(*) = 3)"


@query("H10", sql(f"SELECT fid, a, b, c FROM {_MERGED_FACES}", "S_vertex", "S_face"))
def merged_meshes(t: Tables) -> DataFrame:
    vertex = t.vertices()
    _, face = mesh.merge_meshes(t.faces(vertex), vertex, _meshes(vertex, None))
    return face.select("fid", "a", "b", "c")


@query("A9 H10", sql(f"""
    SELECT 2 AS section, fid AS position, 'f ' || (a + 1) || ' ' || (b + 1) || ' ' || (c + 1) AS value FROM {_MERGED_FACES}
    UNION ALL SELECT 1, vid + o, printf('v %.6f %.6f %.6f', CAST(CAST(z + mesh_id % 5 AS FLOAT) AS DOUBLE), CAST(CAST(y + 2e0 AS FLOAT) AS DOUBLE), CAST(CAST(3e0 - x AS FLOAT) AS DOUBLE)) FROM S_vertex JOIN {_OFFSETS} USING (mesh_id)
    UNION ALL SELECT 0, 0, concat_ws(chr(10), '# final overlay mesh', '# source: s', '# coordinate_frame: map', '# captured_at: then', '# vertex_count: ' || (SELECT count(*) FROM S_vertex),
        '# triangle_count: ' || (SELECT count(*) FROM {_MERGED_FACES}), 'o final_overlay_mesh')""", "S_vertex", "S_face"))
def obj_lines(t: Tables) -> DataFrame:
    vertex = t.vertices()
    whole, face = mesh.merge_meshes(t.faces(vertex), vertex, _meshes(vertex, None))
    return artifacts.obj_lines(whole.withColumnRenamed("snapshot_id", "mesh_id"), face.withColumnRenamed("snapshot_id", "mesh_id"), "s", "map", "then")


@query("A10", sql(f"""
    SELECT '{{"captured_at":"","coordinate_frame":"map","obj_file":"final_overlay_mesh.obj","schema_version":1,"source":"s","triangle_count":' || (SELECT count(*) FROM {_VALID}) || ',"vertex_count":' || (SELECT count(*) FROM S_vertex) || '}}' AS value""", "S_vertex", "S_face"))
def mesh_sidecar(t: Tables) -> DataFrame:
    vertex = t.vertices()
    return artifacts.mesh_metadata(vertex, t.faces(vertex), "s", "map", "")


@query("H11", sql(f"""
    WITH RECURSIVE flags AS MATERIALIZED (SELECT f.mesh_id, f.fid, f.mesh_id // 16 AS snapshot_id, v.fid IS NOT NULL AS ok FROM S_face f LEFT JOIN {_VALID} v USING (mesh_id, fid)),
    took AS (
        SELECT snapshot_id, min(mesh_id) - 1 AS mesh_id, CAST(0 AS BIGINT) AS included, CAST(0 AS BIGINT) AS share FROM flags GROUP BY snapshot_id
        UNION ALL
        SELECT k.snapshot_id, k.mesh_id + 1, k.included + 3 * (SELECT count(*) FROM flags f WHERE f.mesh_id = k.mesh_id + 1 AND f.ok AND f.fid < (4500 - k.included) // 3), (4500 - k.included) // 3
        FROM took k WHERE k.mesh_id + 1 < (k.snapshot_id + 1) * 16 AND k.mesh_id < (SELECT max(mesh_id) FROM flags)),
    chosen AS MATERIALIZED (
        SELECT f.snapshot_id, f.mesh_id, f.fid, unnest([0, 1, 2]) AS corner, unnest([s.a, s.b, s.c]) AS vid
        FROM flags f JOIN took k ON f.mesh_id = k.mesh_id AND f.fid < k.share JOIN S_face s ON s.mesh_id = f.mesh_id AND s.fid = f.fid WHERE f.ok)
    SELECT snapshot_id, mesh_id, fid, corner, {_qn('z + mesh_id % 5')} AS x, {_qn('y + 2e0')} AS y, {_qn('3e0 - x')} AS z FROM chosen JOIN S_vertex USING (mesh_id, vid)""", "S_vertex", "S_face"))
def triangle_soup(t: Tables) -> DataFrame:
    vertex = t.vertices()
    soup = mesh.triangle_soup(t.faces(vertex), vertex, _meshes(vertex), 4500)
    return soup.select("snapshot_id", "mesh_id", "fid", "corner", *[_near(F.col(c)).alias(c) for c in "xyz"])


# --- grid mesh -----------------------------------------------------------------------------------------------------------

_GRID = "(SELECT frame, px, py, 1.5e0 * relative - 0.2e0 AS d, row_number() OVER (PARTITION BY frame ORDER BY py, px) - 1 AS vid FROM S_depth WHERE 1.5e0 * relative - 0.2e0 > 0.1e0)"
_SMOOTH = "greatest(p.d, q.d, r.d) - least(p.d, q.d, r.d) <= greatest(0.45e0, least(p.d, q.d, r.d) * 0.18e0)"


@query("H4", sql(f"""
    SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY py, cc, half) - 1 AS fid, a, b, c FROM (
        SELECT p.frame AS mesh_id, p.py, p.px AS cc, 0 AS half, p.vid AS a, q.vid AS b, r.vid AS c FROM {_GRID} p JOIN {_GRID} q ON q.frame = p.frame AND q.px = p.px AND q.py = p.py + 1
        JOIN {_GRID} r ON r.frame = p.frame AND r.px = p.px + 1 AND r.py = p.py WHERE {_SMOOTH}
        UNION ALL
        SELECT p.frame, p.py, p.px - 1, 1, p.vid, q.vid, r.vid FROM {_GRID} p JOIN {_GRID} q ON q.frame = p.frame AND q.px = p.px - 1 AND q.py = p.py + 1
        JOIN {_GRID} r ON r.frame = p.frame AND r.px = p.px AND r.py = p.py + 1 WHERE {_SMOOTH})""", "S_depth"))
def grid_meshes(t: Tables) -> DataFrame:
    flat = t.intrinsics().select("frame", F.lit(1.5).alias("scale"), F.lit(-0.2).alias("offset"))
    _, face = mesh.grid_mesh(t.depth(), t.intrinsics(), flat)
    return face


_FITS = """(SELECT frame, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS scale, (sy * sxx - sx * sxy) / (sw * sxx - sx * sx) AS shift FROM (
    SELECT frame, sum(w) AS sw, sum(w * relative) AS sx, sum(w * depth) AS sy, sum(w * relative * relative) AS sxx, sum(w * relative * depth) AS sxy FROM (
        SELECT *, CASE confidence WHEN 0 THEN 0.2e0 WHEN 1 THEN 0.65e0 ELSE 1e0 END / (greatest(0.015e0, 0.012e0 + 0.004e0 * depth * depth) * greatest(0.015e0, 0.012e0 + 0.004e0 * depth * depth)) AS w
        FROM S_depth WHERE px % 4 = 0 AND py % 4 = 0 AND depth > 0.2e0 AND depth < 5e0) GROUP BY frame HAVING count(*) > 50))"""


@query("H4 D8", sql(f"""
    WITH G AS MATERIALIZED (SELECT frame, px, py, scale * relative + shift AS d FROM S_depth JOIN {_FITS} USING (frame) WHERE scale * relative + shift > 0.1e0),
    T AS (SELECT p.frame FROM G p JOIN G q ON q.frame = p.frame AND q.px = p.px AND q.py = p.py + 1 JOIN G r ON r.frame = p.frame AND r.px = p.px + 1 AND r.py = p.py WHERE {_SMOOTH}
          UNION ALL SELECT p.frame FROM G p JOIN G q ON q.frame = p.frame AND q.px = p.px - 1 AND q.py = p.py + 1 JOIN G r ON r.frame = p.frame AND r.px = p.px AND r.py = p.py + 1 WHERE {_SMOOTH})
    SELECT frame AS mesh_id, vertices, triangles, mean_x FROM (SELECT frame, count(*) AS vertices, {_qn('sum(frame - d) / count(*)', '1e4')} AS mean_x FROM G GROUP BY frame)
    JOIN (SELECT frame, count(*) AS triangles FROM T GROUP BY frame) USING (frame)""", "S_depth"))
def calibrated_grid_meshes(t: Tables) -> DataFrame:
    """Vertices and triangles per frame with each frame's own calibration."""
    fits = calibration.fit_calibration(t.depth().withColumnsRenamed({"px": "lx", "py": "ly"}))
    vertex, face = mesh.grid_mesh(t.depth(), t.intrinsics(), fits)
    counts = face.groupBy("mesh_id").agg(F.count("*").alias("triangles"))
    return vertex.groupBy("mesh_id").agg(F.count("*").alias("vertices"), _near(F.sum("x") / F.count("*"), 1e4).alias("mean_x")).join(counts, "mesh_id")
