"""Stamps: nanoseconds since the epoch as BIGINT, seconds as DOUBLE where the source is a clock reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def join_stamp(sec: Column, nanosec: Column) -> Column:
    return sec.cast("bigint") * F.lit(NANOS) + nanosec.cast("bigint")


def message_stamp_ns(msg: Column, received_ns: Column) -> Column:
    """Header stamp of the JSON message, else that of its first transform, else the receive time."""

    def at(prefix: str) -> Column:
        return join_stamp(
            F.get_json_object(msg, f"{prefix}.stamp.sec"), F.get_json_object(msg, f"{prefix}.stamp.nanosec")
        )

    return F.coalesce(at("$.header"), at("$.transforms[0].header"), received_ns.cast("bigint"))


def uptime_to_epoch(now: Column, uptime: Column, stamp: Column) -> Column:
    """A clock reading since boot moved to the epoch."""
    return now - uptime + stamp


def split_stamp(seconds: Column) -> Column:
    """Epoch seconds as {sec, nanosec}, both truncated toward zero."""
    sec = seconds.cast("bigint")
    return F.struct(sec.alias("sec"), ((seconds - sec) * F.lit(1e9)).cast("bigint").alias("nanosec"))


def age_seconds(now_ns: Column, stamp_ns: Column) -> Column:
    return F.abs(now_ns - stamp_ns) / F.lit(1e9)


def duration_ns(start_ns: Column, end_ns: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(end_ns - start_ns, F.lit(0))).cast("bigint")
