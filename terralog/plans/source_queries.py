"""Queries through files: the tables are written in a source's format to the shared folder and read back with its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.functions.binary import base64_text
from terralog.operators import joins, log, quality, telemetry
from terralog.plans.registry import query, sql
from terralog.plans.views import Tables
from terralog.session import scratch_path
from terralog.sources import bag, envelopes

@query("C1", sql("""
    SELECT session_id, chunk, row_id, topic, 'std_msgs' || topic AS type, stamp_ns, bytes AS k FROM S_msg""", "S_msg"))
def messages_from_chunks(t: Tables) -> DataFrame:
    """Messages with topic ids per chunk, landed as Parquet, read back and joined with their topics."""
    rows = t.msg().select("session_id", "chunk", "row_id", "topic", "stamp_ns", "bytes")
    topics = rows.groupBy(F.col("chunk"), "topic").count().select(
        "chunk", F.xxhash64("topic").alias("topic_id"), F.col("topic").alias("name"), F.concat(F.lit("std_msgs"), "topic").alias("type")
    )
    path = scratch_path(t.spark, "landed")
    bag.land_messages(rows.withColumn("data", F.format_string('{"op":"publish","msg":{"k":%d}}', "bytes")), path)
    landed = bag.read_landed(t.spark, path).withColumn("topic_id", F.xxhash64("topic")).drop("topic")
    joined = joins.with_topic(landed, topics)
    return joined.select("session_id", "chunk", "row_id", F.col("name").alias("topic"), "type", "stamp_ns", F.get_json_object("data", "$.msg.k").cast("bigint").alias("k"))


@query("A6 D14", sql("SELECT 'session_id=' || session_id AS session_id, count(DISTINCT chunk) AS chunks, count(DISTINCT chunk) AS files FROM S_msg GROUP BY session_id", "S_msg"))
def session_folders(t: Tables) -> DataFrame:
    """Chunks as files that Spark writes, one per session and chunk, listed and counted."""
    path = scratch_path(t.spark, "chunks")
    lines = t.msg().select("session_id", "chunk", F.to_json(F.struct("row_id", "topic", "stamp_ns", "bytes")).alias("value"))
    lines.repartition("session_id", "chunk").write.partitionBy("session_id", "chunk").text(path)
    listed = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    named = listed.withColumn("path", F.regexp_replace("path", r"/chunk=(\d+)/[^/]+$", "/log_$1.db3"))
    return bag.sessions_of(bag.recording_files(named)).select("session_id", "chunks", "files")


_FILES = "SELECT session_id, chunk, count(*) AS messages, arg_min(stamp_ns, row_id) AS start_ns, arg_max(stamp_ns, row_id) AS end_ns FROM S_msg GROUP BY ALL"


def _write_summaries(t: Tables) -> str:
    """One summary document per session."""
    files = log.bag_files(t.msg())
    file_text = F.format_string(
        "    - path: 'log_%d.db3'\n      starting_time:\n        nanoseconds_since_epoch: %d\n      duration:\n        nanoseconds: %d\n      message_count: %d\n",
        "chunk", "start_ns", "duration_ns", "messages",
    )
    listed = files.groupBy("session_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", file_text.alias("t")))), lambda f: f["t"])).alias("files"))
    topic_text = F.format_string(
        "    - topic_metadata:\n        name: '%s'\n        type: 'std_msgs/msg/String'\n        serialization_format: 'rosbridge_json'\n        offered_qos_profiles: ''\n      message_count: %d\n",
        "topic", "messages",
    )
    topics = log.bag_topics(t.msg()).groupBy("session_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("topic", topic_text.alias("t")))), lambda f: f["t"])).alias("topics"))
    head = F.format_string(
        "rosbag2_bagfile_information:\n  version: 8\n  storage_identifier: sqlite3\n  duration:\n    nanoseconds: %d\n  starting_time:\n    nanoseconds_since_epoch: %d\n  message_count: %d\n  topics_with_message_count:\n",
        "duration_ns", "start_ns", "messages",
    )
    documents = log.bag_summary(t.msg()).select("session_id", head.alias("head")).join(topics, "session_id").join(listed, "session_id")
    text = F.concat("head", "topics", F.lit("  compression_format: ''\n  compression_mode: ''\n  files:\n"), "files", F.lit("  custom_data:\n    note: ''\n"))
    path = scratch_path(t.spark, "summaries")
    documents.select("session_id", text.alias("value")).write.partitionBy("session_id").text(path)
    return path


@query("A3", sql(f"SELECT 'session_id=' || session_id AS session_id, chunk AS chunk, start_ns, greatest(0, end_ns - start_ns) AS duration_ns, messages FROM ({_FILES})", "S_msg"))
def files_in_summaries(t: Tables) -> DataFrame:
    _, _, files = bag.read_bag_metadata(t.spark, [f"{_write_summaries(t)}/*/*.txt"])
    return files.select("session_id", F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("chunk"), "start_ns", "duration_ns", "messages")


@query("A3 J5", sql("SELECT 'session_id=' || session_id AS session_id, topic, count(*) AS stated, count(*) AS found, true AS ok FROM S_msg GROUP BY ALL", "S_msg"))
def summaries_against_log(t: Tables) -> DataFrame:
    _, topics, _ = bag.read_bag_metadata(t.spark, [f"{_write_summaries(t)}/*/*.txt"])
    found = log.bag_topics(t.msg()).withColumn("session_id", F.concat(F.lit("session_id="), F.col("session_id").cast("string")))
    return quality.check_counts(topics, found)


@query("A4", sql("""
    SELECT session_id::VARCHAR AS session_id, '/t' || (row_id % 5) AS topic, 'std_msgs/msg/String' AS type, (row_id + 100) * 1000000000 + row_id AS stamp_ns FROM S_msg""", "S_msg"))
def envelopes_from_lines(t: Tables) -> DataFrame:
    r = F.col("row_id")
    line = F.format_string('{"op":"publish","topic":"/t%d","type":"std_msgs/msg/String","msg":{"header":{"stamp":{"sec":%d,"nanosec":%d}}}}', r % 5, r + 100, r)
    path = scratch_path(t.spark, "lines")
    t.msg().select(F.col("session_id").cast("string").alias("s"), line.alias("value")).write.partitionBy("s").text(path)
    rows = envelopes.read_envelopes(t.spark, f"{path}/*")
    return rows.select(F.regexp_extract("session_id", r"(\d+)$", 1).alias("session_id"), "topic", "type", "stamp_ns")


@query("A5 B8", sql("SELECT session_id, topic, stamp_ns, 'img' || row_id AS image FROM S_msg", "S_msg"))
def typed_tables(t: Tables) -> DataFrame:
    """Image messages written as typed tables and read back."""
    n = F.col("row_id").cast("string")
    encoded = base64_text(F.concat(F.lit("img"), n).cast("binary"))
    rows = t.msg().select("session_id", "topic", F.lit("sensor_msgs/msg/CompressedImage").alias("type"), "stamp_ns", F.format_string('{"format":"jpeg","data":"%s"}', encoded).alias("msg"))
    written = envelopes.write_topics(rows, scratch_path(t.spark, "typed"), ["sensor_msgs/msg/CompressedImage"])
    back = t.spark.read.parquet(written[0])
    return back.select(F.col("session_id").cast("bigint").alias("session_id"), "topic", "stamp_ns", F.col("data").cast("string").alias("image"))


# --- landed in order -------------------------------------------------------------------------------------------------------


def _in_order(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ordered")
    return bag.land_ordered(t.msg(), f"ordered_{path[-32:]}", path, 16, 6 * 3600 * 10**9)


@query("A5 C2", sql("""
    SELECT e.session_id, e.row_id, v.row_id AS right_row_id, v.bytes AS right_bytes FROM (SELECT * FROM S_msg WHERE topic = '/error') e
    ASOF LEFT JOIN (SELECT * FROM S_msg WHERE topic = '/view') v ON e.session_id = v.session_id AND e.stamp_ns >= v.stamp_ns""", "S_msg"))
def landed_view_at_error(t: Tables) -> DataFrame:
    """The last view before each error, from a table landed by session and stretch of time."""
    rows = joins.asof_topics(_in_order(t), "/error", "/view", ["row_id", "bytes"], block="stretch")
    return rows.select("session_id", "row_id", "right_row_id", "right_bytes")


@query("A5 E13", sql("""
    SELECT session_id, row_id, stamp_ns - lag(stamp_ns) OVER (PARTITION BY session_id ORDER BY stamp_ns, row_id) > 3600000000000 IS TRUE AS stale FROM S_msg""", "S_msg"))
def landed_gaps(t: Tables) -> DataFrame:
    """Silences of an hour, from the same table."""
    return telemetry.staleness(_in_order(t), ["session_id"], "stamp_ns", "row_id", 3600.0, block="stretch").select("session_id", "row_id", "stale")
