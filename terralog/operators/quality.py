"""Checks on recorded data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.dimensions import RATE_TARGETS
from terralog.functions.numeric import is_finite
from terralog.operators.log import missing_topics, topic_rates
from terralog.operators.ordered import BUCKET_ROWS, OrderedRows

MAX_FRAME_POINTS = 2_000_000
QUEUE_CAPACITY = 120
BUFFER_CAPS = {"cloud": 30, "mesh": 5}
BUFFER_BYTES = 20_000_000


def check_rates(df: DataFrame, targets: Mapping[str, float] | None = None, tolerance: float = 0.10) -> DataFrame:
    """Observed rate per session and topic against its target; a session without the topic has no messages and fails.

    The targets are constants, listed once per session.
    """
    wanted = targets or {t[1]: t[2] for t in RATE_TARGETS}
    listed = F.array(*[F.struct(F.lit(k).alias("topic"), F.lit(float(v)).alias("target_hz")) for k, v in wanted.items()])
    expected = df.select("session_id").distinct().select("session_id", F.explode(listed).alias("_t")).select("session_id", "_t.*")
    rates = topic_rates(df.filter(F.col("topic").isin(*wanted)))
    told = expected.join(rates, ["session_id", "topic"], "left").fillna(0, ["messages", "bytes"])
    near = F.abs(F.col("rate_hz") - F.col("target_hz")) <= F.col("target_hz") * F.lit(tolerance)
    return told.withColumn("ok", F.coalesce(near, F.lit(False)))


def check_topics(df: DataFrame, required: Sequence[str], known_types: DataFrame) -> DataFrame:
    """Problems per session: required topics that are missing, and topics of an unknown type."""
    missing = missing_topics(required, df).withColumn("problem", F.lit("missing"))
    seen = df.select("session_id", "topic", "type").distinct()
    unknown = seen.join(known_types.select("type").distinct(), "type", "left_anti").select("session_id", "topic", F.lit("unknown type").alias("problem"))
    return missing.unionByName(unknown)


def check_finite(df: DataFrame, fields: Sequence[str], key: Sequence[str] = ("topic",)) -> DataFrame:
    """Non-finite values per key and field (null is not counted)."""
    counts = df.groupBy(*key).agg(*[F.count_if(F.col(f).isNotNull() & ~is_finite(F.col(f))).alias(f) for f in fields])
    return counts.unpivot(list(key), list(fields), "field", "non_finite")


def check_clock(df: DataFrame, key: Sequence[str] = ("session_id", "topic"), width: int | None = BUCKET_ROWS) -> DataFrame:
    """Drift of receive time against stamp (slope - 1) and number of steps back, in arrival order."""
    rows = OrderedRows(df, key, ["row_id"], width=width).previous("_b", "stamp_ns").result()
    # offsets from the first value keep the squared sums within double precision
    seconds = {c: (F.col(c) - F.lit(1_700_000_000_000_000_000)) / F.lit(1e9) for c in ("stamp_ns", "recv_ns")}
    return rows.groupBy(*key).agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("stamp_ns") < F.col("_b.stamp_ns")).alias("backward_steps"),
        (F.regr_slope(seconds["recv_ns"], seconds["stamp_ns"]) - F.lit(1.0)).alias("drift"),
    )


def check_counts(stated: DataFrame, found: DataFrame, key: Sequence[str] = ("session_id", "topic")) -> DataFrame:
    """Stated and found message counts side by side, with those that differ marked."""
    a = stated.select(*key, F.col("messages").alias("stated"))
    b = found.select(*key, F.col("messages").alias("found"))
    joined = a.join(b, list(key), "full").fillna(0, ["stated", "found"])
    return joined.withColumn("ok", F.col("stated") == F.col("found"))


def check_limits(frames: DataFrame, queues: DataFrame, buffers: DataFrame) -> DataFrame:
    """Sessions that reach a limit: points in a frame, queue depth, buffered samples or bytes."""
    points = frames.groupBy("session_id", "frame").agg(F.count("*").alias("_n")).filter(F.col("_n") >= MAX_FRAME_POINTS)
    rows = points.select("session_id", F.lit("frame points").alias("limit_name"))
    rows = rows.unionByName(queues.filter(F.col("depth") >= QUEUE_CAPACITY).select("session_id", F.lit("queue depth").alias("limit_name")))
    full = (
        ((F.col("kind") == "cloud") & (F.col("samples") >= BUFFER_CAPS["cloud"]))
        | ((F.col("kind") == "mesh") & (F.col("samples") >= BUFFER_CAPS["mesh"]))
    )
    rows = rows.unionByName(buffers.filter(full).select("session_id", F.lit("buffer samples").alias("limit_name")))
    totals = buffers.groupBy("session_id").agg(F.sum("bytes").alias("_b")).filter(F.col("_b") >= BUFFER_BYTES)
    rows = rows.unionByName(totals.select("session_id", F.lit("buffer bytes").alias("limit_name")))
    return rows.groupBy("session_id", "limit_name").agg(F.count("*").alias("times"))
