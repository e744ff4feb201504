"""Newline-delimited JSON envelopes ``{op, topic, type?, msg}``, and typed topic tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.functions.numeric import whole_div
from terralog.functions.stamps import message_stamp_ns
from terralog.operators.log import hydrate
from terralog.schemas import MESSAGE_FIELDS
from terralog.session import scratch_path


def _received() -> Column:
    return (F.unix_micros(F.col("_metadata.file_modification_time")) * 1000).alias("_received_ns")


def _message_rows(lines: DataFrame, session: Column, received: Column) -> DataFrame:
    return lines.filter(F.trim("value") != "").select(
        session.alias("session_id"),
        F.get_json_object("value", "$.topic").alias("topic"),
        F.get_json_object("value", "$.type").alias("type"),
        message_stamp_ns(F.get_json_object("value", "$.msg"), received).alias("stamp_ns"),
        F.col("value").alias("data"),
    )


def read_envelopes(spark: SparkSession, path: str | Sequence[str], session_id: str | None = None) -> DataFrame:
    """Message rows of JSON-lines files; the folder names the session unless one is given, and the file time is the
    receive time of messages without a stamp."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), _received())
    session = F.lit(session_id) if session_id else F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    return _message_rows(lines, session, F.col("_received_ns"))


def stream_envelopes(spark: SparkSession, path: str, session_id: str, max_files: int = 1000) -> DataFrame:
    """The same rows as a stream of arriving files."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return _message_rows(lines, F.lit(session_id), F.unix_micros(F.current_timestamp()) * 1000)


def stream_kafka_envelopes(spark: SparkSession, servers: str, topics: str, session_id: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The same rows from Kafka (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    raw = reader.options(**dict(options or {})).load()
    lines = raw.select(F.col("value").cast("string").alias("value"), (F.unix_micros("timestamp") * 1000).alias("_received_ns"))
    return _message_rows(lines, F.lit(session_id), F.col("_received_ns"))


def write_topics(
    decoded: DataFrame, path: str, types: Sequence[str], force: bool = False, known: Mapping[str, tuple] = MESSAGE_FIELDS, mode: str = "skip"
) -> list[str]:
    """One typed Parquet table per message type, partitioned by session and topic, and a table ``rejects`` beside them.

    ``decoded`` has ``session_id, topic, type, stamp_ns, msg``.  Existing output is refused unless ``force``.  The rows
    are landed once by type, so that decoding runs once and each typed write reads only its own part.  Rows of other
    types, and rows whose fields do not fit, go to ``rejects`` with their reason; with ``mode="fail"`` the first one
    stops the write.
    """
    for name in types:
        if name not in known:
            raise KeyError(f"no schema for {name}")
    spark, save = decoded.sparkSession, "overwrite" if force else "errorifexists"
    landed = scratch_path(spark, "by-type")
    kept = decoded.select("session_id", "topic", F.coalesce("type", F.lit("null")).alias("type"), "stamp_ns", "msg")
    kept.write.partitionBy("type").parquet(landed)
    rows = spark.read.schema(kept.schema).parquet(landed)

    def refused(df: DataFrame, reason: str) -> DataFrame:
        told = df.select("session_id", "topic", "type", "stamp_ns", "msg", F.concat(F.lit(reason), "type").alias("reason"))
        return told.withColumn("reason", F.raise_error("reason").cast("string")) if mode == "fail" else told

    rejects = refused(rows.filter(~F.col("type").isin(*types)), "no schema for ")
    written = []
    for name in types:
        hydrated = hydrate(rows.filter(F.col("type") == name), name, known)
        rejects = rejects.unionByName(refused(hydrated.filter("_failed"), "fields do not fit "))
        # a type with a field named like a key column stays nested
        clash = {"session_id", "topic", "stamp_ns"} & {n for n, _ in known[name]}
        out = hydrated.filter(~F.col("_failed")).select("session_id", "topic", "stamp_ns", "message" if clash else "message.*")
        written.append((f"{path}/{name.replace('/', '.')}", out))
    rejects.write.mode(save).parquet(f"{path}/rejects")
    for target, out in written:
        spread = out.repartition("session_id", "topic", whole_div(F.col("stamp_ns"), 3600 * 10**9))
        spread.write.mode(save).partitionBy("session_id", "topic").parquet(target)
    return [target for target, _ in written]
