"""Streams that built-in operators express: decoding, deduplication, windows, sessions by gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.numeric import whole_div
from terralog.operators.log import decode_envelope, hydrate_good


def event_time(stamp_ns: Column) -> Column:
    return F.timestamp_micros(whole_div(stamp_ns, 1000))


def stream_decode(envelopes: DataFrame, message_type: str | None = None) -> DataFrame:
    """Live decoding; bad envelopes are left out (see ``envelope_rejects`` for a side output)."""
    decoded = decode_envelope(envelopes)
    return hydrate_good(decoded, message_type) if message_type else decoded


def stream_dedup(radio: DataFrame, watermark: str = "10 minutes", key: str = "dedup_key") -> DataFrame:
    """First row of each key within the watermark; the exact form over stored rows is ``joins.unpublished``."""
    timed = radio.withColumn("event_time", event_time(F.col("stamp_ns"))).withWatermark("event_time", watermark)
    return timed.dropDuplicatesWithinWatermark([key])


def stream_topic_rates(df: DataFrame, window: str = "1 minute", slide: str | None = None, watermark: str = "5 minutes") -> DataFrame:
    """Messages, bytes, rate and bandwidth per session, topic and window; a window is final when the watermark passes it."""
    timed = df.withColumn("event_time", event_time(F.col("stamp_ns"))).withWatermark("event_time", watermark)
    frame = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    sums = timed.groupBy("session_id", "topic", frame.alias("w")).agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / F.lit(1e6)
    return sums.select(
        "session_id", "topic", (F.unix_micros("w.start") * 1000).alias("start_ns"), "messages", "bytes",
        (F.col("messages") / seconds).alias("rate_hz"), (F.col("bytes") * 8 / seconds / F.lit(1e6)).alias("mbps"),
    )


def stream_gap_sessions(df: DataFrame, gap: str = "30 seconds", watermark: str = "5 minutes", key: str = "source") -> DataFrame:
    """Sessions by silence, where no lifecycle topic was recorded."""
    timed = df.withColumn("event_time", event_time(F.col("stamp_ns"))).withWatermark("event_time", watermark)
    sums = timed.groupBy(key, F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("messages"))
    return sums.select(key, (F.unix_micros("w.start") * 1000).alias("start_ns"), (F.unix_micros("w.end") * 1000).alias("end_ns"), "messages")
