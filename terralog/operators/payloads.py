"""Binary payloads: cloud, surfel and mesh blobs to rows and back.  Numpy reads and writes the bytes inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.numeric import whole_div
from terralog.functions.binary import base64_text
from terralog.functions.camera import pack_rgb
from terralog.operators.ordered import OrderedRows

# Fixed values of the point formats: numpy format by field datatype code.
DATATYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
POINT_FIELDS = (("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("rgb", 12, 6))
POINT_STEP = 16
SURFEL_FIELDS = (
    ("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("normal_x", 12, 7), ("normal_y", 16, 7), ("normal_z", 20, 7), ("radius", 24, 7),
    ("confidence", 28, 7), ("rgb", 32, 6), ("observation_count", 36, 6),
)
SURFEL_STEP = 40
FIELDS_TYPE = "array<struct<name:string,offset:int,datatype:int,count:int>>"

PACK_ROWS = 48 * 1024  # a multiple of three, so the base64 texts of full parts join without padding
EMIT_ROWS = 64 * 1024


def field_array(fields: Sequence[tuple[str, int, int]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(o).alias("offset"), F.lit(d).alias("datatype"), F.lit(1).alias("count"))
            for n, o, d in fields
        ]
    )


# --- blobs to rows -----------------------------------------------------------------------------------------------------


def _explode_blob(df: DataFrame, key: Sequence[str], wanted: Sequence[str], blob: str) -> DataFrame:
    """One row per record of ``blob`` (bytes), read with the message's own ``fields`` and ``point_step``."""
    key = list(key)
    schema = T.StructType(
        [df.schema[k] for k in key] + [T.StructField("seq", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in wanted]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                message = {c: batch.column(c)[row] for c in batch.schema.names}
                data = message[blob].as_buffer() if message[blob].is_valid else None
                step = message["point_step"].as_py() or 0
                if data is None or step <= 0:
                    continue
                layout = {f["name"]: f for f in message["fields"].as_py() or () if f["datatype"] in DATATYPES and f["name"] in wanted}
                dtype = np.dtype(
                    {
                        "names": list(layout),
                        "formats": [DATATYPES[f["datatype"]] for f in layout.values()],
                        "offsets": [f["offset"] for f in layout.values()],
                        "itemsize": step,
                    }
                )
                count = data.size // step
                records = np.frombuffer(data, dtype=dtype, count=count)
                for start in range(0, count, EMIT_ROWS):
                    part = records[start : start + EMIT_ROWS]
                    columns = [pa.repeat(message[k], len(part)) for k in key]
                    columns.append(pa.array(np.arange(start, start + len(part), dtype=np.int64)))
                    for c in wanted:
                        values = part[c].astype(np.float64) if c in layout else np.zeros(len(part))
                        columns.append(pa.array(values))
                    yield pa.RecordBatch.from_arrays(columns, names=[*key, "seq", *wanted])

    return df.select(*key, "point_step", "fields", blob).mapInArrow(read, schema)


def _with_colour(points: DataFrame) -> DataFrame:
    rgb = F.col("rgb").cast("bigint")
    return points.withColumns(
        {c: F.shiftright(rgb, s).bitwiseAND(F.lit(255)).cast("smallint") for c, s in (("r", 16), ("g", 8), ("b", 0))}
    ).drop("rgb")


def explode_cloud(messages: DataFrame, key: Sequence[str] = ("session_id", "stamp_ns")) -> DataFrame:
    """Points of cloud messages (base64 ``data``)."""
    blobs = messages.withColumn("_blob", F.try_to_binary("data", F.lit("base64")))
    return _with_colour(_explode_blob(blobs, key, ["x", "y", "z", "rgb"], "_blob"))


def explode_surfel_cloud(messages: DataFrame, key: Sequence[str] = ("session_id", "stamp_ns")) -> DataFrame:
    blobs = messages.withColumn("_blob", F.try_to_binary("data", F.lit("base64")))
    rows = _with_colour(_explode_blob(blobs, key, [n for n, _, _ in SURFEL_FIELDS], "_blob"))
    return rows.withColumn("observation_count", F.col("observation_count").cast("bigint"))


def explode_snapshot(messages: DataFrame, key: Sequence[str] = ("session_id", "stamp_ns", "snapshot_id")) -> tuple[DataFrame, DataFrame]:
    """(vertex, face) rows of mesh snapshots."""
    def part(data: str, step: int, fields: Sequence[tuple[str, int, int]]) -> DataFrame:
        rows = messages.select(
            *key, F.lit(step).alias("point_step"), field_array(fields).alias("fields"), F.try_to_binary(data, F.lit("base64")).alias("_blob")
        )
        return _explode_blob(rows, key, [f[0] for f in fields], "_blob")

    vertex = part("vertex_data", 12, (("x", 0, 7), ("y", 4, 7), ("z", 8, 7))).withColumnRenamed("seq", "vid")
    face = part("index_data", 12, (("a", 0, 6), ("b", 4, 6), ("c", 8, 6))).withColumnRenamed("seq", "fid")
    return vertex, face.withColumns({c: F.col(c).cast("bigint") for c in "abc"})


# --- rows to blobs -----------------------------------------------------------------------------------------------------


def pack_rows(rows: DataFrame, group: Sequence[str], index: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(group, rows, data): base64 of the rows' records in ``index`` order.

    ``index`` counts from 0 without gaps.  Fixed-size parts are packed in parallel, so a large message is many tasks;
    only their finished texts are joined.
    """
    group = list(group)
    dtype = np.dtype([(c, f) for c, f in fields])
    schema = T.StructType(
        [rows.schema[g] for g in group]
        + [T.StructField("_part", T.LongType()), T.StructField("_rows", T.LongType()), T.StructField("_bytes", T.BinaryType())]
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        records = np.zeros(table.num_rows, dtype=dtype)
        for c, _ in fields:
            records[c] = table[c].to_numpy()
        columns = {g: table[g].slice(0, 1) for g in group}
        columns |= {"_part": table["_part"].slice(0, 1), "_rows": pa.array([len(records)], pa.int64()), "_bytes": pa.array([records.tobytes()], pa.binary())}
        return pa.table(columns)

    needed = rows.select(*group, index, *[c for c, _ in fields]).withColumn("_part", whole_div(F.col(index), PACK_ROWS))
    parts = needed.groupBy(*group, "_part").applyInArrow(pack, schema)
    listed = F.array_sort(F.collect_list(F.struct("_part", "_bytes")))  # bytes travel, texts do not
    return parts.groupBy(*group).agg(F.sum("_rows").alias("rows"), F.concat_ws("", F.transform(listed, lambda p: base64_text(p["_bytes"]))).alias("data"))


def _collect(points: DataFrame, key: Sequence[str], order: str, fields: Sequence[tuple[str, int, int]], step: int) -> DataFrame:
    rgb = pack_rgb(F.col("r"), F.col("g"), F.col("b")).cast("bigint")
    ranked = OrderedRows(points.withColumn("rgb", rgb), list(key), [order]).rank("_i").result().withColumn("_i", F.col("_i") - 1)
    packed = pack_rows(ranked, key, "_i", [(n, DATATYPES[d]) for n, _, d in fields])
    return packed.select(
        *key, F.lit(1).alias("height"), F.col("rows").alias("width"), field_array(fields).alias("fields"), F.lit(False).alias("is_bigendian"),
        F.lit(step).alias("point_step"), (F.col("rows") * step).alias("row_step"), "data", F.lit(True).alias("is_dense"),
    )


def collect_cloud(points: DataFrame, key: Sequence[str] = ("session_id", "stamp_ns"), order: str = "seq") -> DataFrame:
    """One cloud message per key from its points."""
    return _collect(points, key, order, POINT_FIELDS, POINT_STEP)


def collect_surfels(surfels: DataFrame, key: Sequence[str] = ("session_id", "stamp_ns"), order: str = "seq") -> DataFrame:
    return _collect(surfels, key, order, SURFEL_FIELDS, SURFEL_STEP)


# --- fitting into a payload limit --------------------------------------------------------------------------------------


def envelope_base(topic: str, header: Column, snapshot_id: Column, source: str, frame_id: str, anchors: Column, original_vertices: Column, original_triangles: Column, metadata: str = "{}") -> Column:
    """Bytes of a mesh envelope without its two blobs, its two counts and its truncated flag."""
    message = F.struct(
        anchors.cast("bigint").alias("anchor_count"), F.lit("mesh_snapshot_binary_base64").alias("compression"), F.lit(frame_id).alias("frame_id"),
        header.alias("header"), F.lit("").alias("index_data"), F.lit("uint32_le_base64").alias("index_encoding"), F.lit(4).alias("index_stride_bytes"),
        F.lit(metadata).alias("metadata_json"), F.lit(0).alias("original_payload_bytes"), original_triangles.alias("original_triangle_count"),
        original_vertices.alias("original_vertex_count"), F.lit(0).alias("published_payload_bytes"), F.lit(1).alias("schema_version"),
        snapshot_id.alias("snapshot_id"), F.lit(source).alias("source"), F.lit("").alias("vertex_data"),
        F.lit("float32_xyz_le_base64").alias("vertex_encoding"), F.lit(12).alias("vertex_stride_bytes"),
    )
    text = F.to_json(F.struct(message.alias("msg"), F.lit("publish").alias("op"), F.lit(topic).alias("topic")))
    return F.octet_length(text) + F.lit(len('"is_truncated":,"triangle_count":,"vertex_count":,'))


def _digits(number: Column) -> Column:
    return F.length(number.cast("string"))


def _base64_length(number: Column) -> Column:
    return whole_div(number + 2, 3) * 4


def fit_snapshot(triangles: DataFrame, snapshots: DataFrame, max_bytes: int, limit: int | None = None) -> DataFrame:
    """(snapshot_id, fitted): the most triangles of each snapshot, from the first on, whose envelope fits; 0 if none does.

    ``triangles`` has ``snapshot_id, tri`` (from 1) and ``new_vertices``; ``snapshots`` has ``base_bytes`` and
    ``original_triangle_count``.  The size of each prefix follows from its counts.
    """
    used = OrderedRows(triangles.select("snapshot_id", "tri", "new_vertices"), ["snapshot_id"], ["tri"], limit)
    counted = used.cumulative("_vertices", F.col("new_vertices")).result()
    sized = counted.join(snapshots.select("snapshot_id", "base_bytes", "original_triangle_count"), "snapshot_id")
    tri, vertices = F.col("tri"), F.col("_vertices")
    flag = F.when(tri < F.col("original_triangle_count"), len("true")).otherwise(len("false"))
    size = F.col("base_bytes") + flag + _digits(tri) + _digits(vertices) + _base64_length(12 * vertices) + _base64_length(12 * tri)
    return sized.groupBy("snapshot_id").agg(F.coalesce(F.max(F.when(size <= max_bytes, tri)), F.lit(0)).cast("bigint").alias("fitted"))


def fit_points(lists: DataFrame, max_bytes: int) -> DataFrame:
    """List form: ``fitted`` points of ``points``, the largest multiple of three whose envelope fits; needs only the counts.

    A triangle takes 64 bytes in the two blobs, and the digits of the counts take less than that, so the answer is the
    room divided by 64, or one less.
    """
    base, points = F.col("base_bytes"), F.col("points")

    def size(triangles: Column, flag: str) -> Column:
        return base + len(flag) + triangles * 64 + _digits(triangles) + _digits(triangles * 3)

    all_of = whole_div(points, 3)
    room = whole_div(F.greatest(max_bytes - base - len("true"), F.lit(0)), 64)
    part = F.least(room, F.when(points % 3 == 0, all_of - 1).otherwise(all_of))
    cut = F.when(size(part, "true") <= max_bytes, part).otherwise(F.greatest(part - 1, F.lit(0)))
    whole = (points % 3 == 0) & (size(all_of, "false") <= max_bytes)
    return lists.withColumn("fitted", F.when(whole, points).otherwise(F.greatest(cut, F.lit(0)) * 3).cast("bigint"))


def fit_markers(points: DataFrame, base_bytes: int, max_bytes: int, limit: int | None = None) -> DataFrame:
    """(message_id, marker, kept): the most points, from the first on, with which the marker message fits.

    Markers before the last kept one stay whole; that one stays whole or keeps a multiple of three points.
    ``points`` has ``message_id, marker, position`` (both from 0), ``point_bytes`` (JSON text of the point) and
    ``marker_bytes`` (the marker's JSON without points).  Bytes are summed in order, so a message may have any number.
    """
    first = F.col("position") == 0
    # what a point adds: itself and a comma; the first of a marker has none, but brings the marker and its comma
    adds = F.col("point_bytes") + F.when(first, F.col("marker_bytes") + (F.col("marker") > 0).cast("int")).otherwise(1)
    rows = points.select("message_id", "marker", "position", adds.cast("bigint").alias("_adds"))
    summed = OrderedRows(rows, ["message_id"], ["marker", "position"], limit).cumulative("_bytes", F.col("_adds")).result()
    counts = points.groupBy("message_id", "marker").agg(F.count("*").alias("_n"))
    ends = summed.join(counts, ["message_id", "marker"]).filter(((F.col("position") + 1) % 3 == 0) | (F.col("position") + 1 == F.col("_n")))
    last = ends.filter(F.col("_bytes") + base_bytes <= max_bytes).groupBy("message_id").agg(F.max(F.struct("marker", "position")).alias("_last"))
    kept = counts.join(last, "message_id").filter(F.col("marker") <= F.col("_last.marker"))
    return kept.select("message_id", "marker", F.when(F.col("marker") == F.col("_last.marker"), F.col("_last.position") + 1).otherwise(F.col("_n")).cast("bigint").alias("kept"))
