"""Streams written batch by batch: late rows kept aside, several tables from one stream, live tables under a cap.

Each batch writes below its own number, and a batch that is complete is not written again.  So a batch that runs a second
time, because the driver was lost between its writes and its commit, neither doubles nor changes rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from terralog.functions.numeric import is_finite
from terralog.operators import log, points
from terralog.operators.ordered import key_stream
from terralog.schemas import MESSAGE_FIELDS


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def is_done(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def put(rows: DataFrame, path: str, number: int, parts: Sequence[str] = ()) -> None:
    """Write the rows of batch ``number`` as ``path/batch=number``, unless that is complete."""
    target = f"{path}/batch={number}"
    if not is_done(rows.sparkSession, target):
        rows.write.mode("overwrite").partitionBy(*parts).parquet(target)


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches below ``path``, in order: a listing of folders, no data is read."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = [int(m[1]) for m in (re.fullmatch(r"batch=(\d+)", n) for n in names) if m]
    return sorted(n for n in found if is_done(spark, f"{path}/batch={n}"))


def written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the complete batches below ``path``."""
    done = [f"{path}/batch={n}" for n in batch_numbers(spark, path)]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*done).select(*schema.names)


# --- late rows ---------------------------------------------------------------------------------------------------------


def split_late(stream: DataFrame, folder: str, delay_ns: int, stamp: str = "stamp_ns") -> DataStreamWriter:
    """Part the rows that come too late from the others.

    A row is late if its stamp is more than ``delay_ns`` behind the newest stamp of all batches before.  On-time rows go to
    ``on_time_rows`` and can be read as a stream, whose own watermark of the same delay then drops nothing; late
    ones go to ``late_rows``.  Nothing vanishes.  A batch is read once; the clock is one row per batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        clock = written(spark, f"{folder}/clock", T.StructType.fromDDL("newest bigint"))
        newest = clock.agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(F.col(stamp) < F.lit(newest - delay_ns), F.lit(False))
        put(batch.withColumn("_late", late), f"{folder}/rows", number, ["_late"])
        rows = spark.read.schema(batch.schema).parquet(f"{folder}/rows/batch={number}")
        put(rows.agg(F.max(stamp).cast("bigint").alias("newest")).filter("newest is not null"), f"{folder}/clock", number)

    return stream.writeStream.foreachBatch(write)


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    whole = written(spark, f"{folder}/rows", T.StructType([*schema.fields, T.StructField("_late", T.BooleanType())]))
    return whole.filter("_late").drop("_late")


def on_time_rows(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """The rows that were not late, as a stream in the order of their batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/rows/*/_late=false")


# --- one stream, typed tables and rejects ------------------------------------------------------------------------------

_REJECTS = "topic string, type string, stamp_ns bigint, reason string"


def land_converted(stream: DataFrame, folder: str, types: Sequence[str], fields: Mapping[str, tuple] = MESSAGE_FIELDS, **options) -> DataStreamWriter:
    """Arriving messages to one typed table per message type and a table of rejects (``log.convert`` with ``options``).

    A batch is converted once, to rows parted by type; the tables are written from those.  Only when all of a batch's
    tables are there does the stream commit it, and a rerun goes on with what is missing.
    """
    kinds = {name: log.message_type(name, fields) for name in types}
    keep = [c for c in ("session_id", "row_id") if c in stream.columns]

    def write(batch: DataFrame, number: int) -> None:
        rows = log.convert(batch, types, fields=fields, **options)
        put(rows.select(*keep, "topic", "type", "stamp_ns", "message", "reason"), f"{folder}/converted", number)
        landed = batch.sparkSession.read.parquet(f"{folder}/converted/batch={number}")
        for name, kind in kinds.items():
            typed = landed.filter((F.col("type") == name) & F.col("reason").isNull())
            put(typed.select(*keep, "topic", "stamp_ns", F.from_json("message", kind).alias("message")), f"{folder}/{name.replace('/', '.')}", number)
        put(landed.filter("reason is not null").select(*keep, "topic", "type", "stamp_ns", "reason"), f"{folder}/rejects", number)

    return stream.writeStream.foreachBatch(write)


def landed_types(spark: SparkSession, folder: str, name: str, keys: str = "", fields: Mapping[str, tuple] = MESSAGE_FIELDS) -> DataFrame:
    """The typed table of one message type; ``keys`` declares the columns in front (``"row_id bigint, "``)."""
    schema = T.StructType.fromDDL(f"{keys}topic string, stamp_ns bigint").add("message", log.message_type(name, fields))
    return written(spark, f"{folder}/{name.replace('/', '.')}", schema)


def landed_rejects(spark: SparkSession, folder: str, keys: str = "") -> DataFrame:
    return written(spark, f"{folder}/rejects", T.StructType.fromDDL(keys + _REJECTS))


# --- live surfels under a cap ------------------------------------------------------------------------------------------

_MEANS = ("x", "y", "z", "r", "g", "b")
_NORMAL = ("nx", "ny", "nz")


def surfel_schema(points_schema: T.StructType, key: Sequence[str]) -> T.StructType:
    """Running state of a surfel: unrounded means, unit normal, number of observations and last update."""
    kept = [points_schema[k] for k in key] + [T.StructField(v, T.LongType()) for v in points.VOXEL]
    kept += [T.StructField(c, T.DoubleType()) for c in (*_MEANS, *_NORMAL)]
    return T.StructType([*kept, T.StructField("observation_count", T.LongType()), T.StructField("updated_at", T.LongType())])


def merged_surfels(live: DataFrame, arrived: DataFrame, voxel: float, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The live surfels after the points that arrived: cells that got points are folded on from their state, in order.

    A cell's state goes in front of its points; cells are the keys, so a session spreads over all tasks.  Cells without
    new points pass by.
    """
    cell, schema = [*key, *points.VOXEL], live.schema
    good = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))
    cells = arrived.filter(good).withColumns(points.voxel_columns(voxel))
    toward = dict(zip(_NORMAL, points.towards_observer()))
    new = cells.select(
        *cell, *[F.col(c).cast("double").alias(c) for c in _MEANS], *[c.alias(n) for n, c in toward.items()], F.lit(None).cast("bigint").alias("observation_count"),
        F.col("stamp_ns").cast("bigint").alias("updated_at"), F.struct(*order).alias("_order"),
    )
    touched = live.join(new.select(*cell).distinct(), cell, "left_semi")
    state = touched.withColumn("_order", F.lit(None).cast(new.schema["_order"].dataType))  # null: in front

    def fold(held, rows: pa.RecordBatch):
        values = list(zip(*[rows.column(c).to_pylist() for c in _MEANS]))
        ways = list(zip(*[rows.column(c).to_pylist() for c in _NORMAL]))
        count = rows.column("observation_count")[0].as_py()
        # the cell's state, if there is one, is its first row
        state, at = (held, 0) if count is None else ((count, values[0], ways[0]), 1)
        n, mean, normal = points.fold_observations(state or (0, None, None), values[at:], ways[at:])
        stamp = rows.column("updated_at")[rows.num_rows - 1].as_py()
        return (n, mean, normal), _surfel_row(rows, cell, mean, normal, n, stamp)

    # a cell that goes on from one Arrow batch to the next gives a row in each; the one of most observations is the last
    folded = key_stream(state.unionByName(new), cell, ["_order"], fold, schema)
    rest = [c for c in schema.names if c not in cell]
    folded = folded.groupBy(*cell).agg(F.max_by(F.struct(*rest), "observation_count").alias("_s")).select(*cell, "_s.*")
    return live.join(new.select(*cell).distinct(), cell, "left_anti").unionByName(folded)


def _surfel_row(rows: pa.RecordBatch, cell: list[str], mean: np.ndarray, normal: np.ndarray, n: int, stamp: int) -> pa.RecordBatch:
    numbers = [pa.array([float(v)]) for v in (*mean, *normal)] + [pa.array([n], pa.int64()), pa.array([stamp], pa.int64())]
    return pa.RecordBatch.from_arrays([*rows.select(cell).slice(rows.num_rows - 1).columns, *numbers], [*cell, *_MEANS, *_NORMAL, "observation_count", "updated_at"])


def keep_surfels(
    stream: DataFrame, folder: str, maximum: int | None, voxel: float = points.SURFEL_VOXEL_M, order: Sequence[str] = ("stamp_ns", "seq"),
    key: Sequence[str] = ("session_id",),
) -> DataStreamWriter:
    """Fuse arriving points into live surfels and keep the ``maximum`` most recently updated of each session after every batch.

    A cell that was dropped and is seen again starts anew.  The live table of a batch is a snapshot below its number and the
    state that the next batch goes on from, so a rerun starts from the same state.
    """
    schema = surfel_schema(stream.schema, key)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if is_done(spark, f"{folder}/batch={number}"):
            return
        before = [n for n in batch_numbers(spark, folder) if n < number]
        live = spark.read.schema(schema).parquet(f"{folder}/batch={before[-1]}") if before else spark.createDataFrame([], schema)
        put(points.trim_surfels(merged_surfels(live, batch, voxel, order, key), maximum, key), folder, number)

    return stream.writeStream.foreachBatch(write)


def live_surfels(spark: SparkSession, folder: str, schema: T.StructType, voxel: float = points.SURFEL_VOXEL_M, at: int | None = None) -> DataFrame:
    """The live surfels after the last batch (or after batch ``at``), with confidence, radius and whole colours."""
    numbers = [n for n in batch_numbers(spark, folder) if at is None or n <= at]
    rows = spark.read.schema(schema).parquet(f"{folder}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], schema)
    return points.surfel_values(rows, voxel)


def run_writer(writer: DataStreamWriter, state: str) -> None:
    """Process all that is there now."""
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

