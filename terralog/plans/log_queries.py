"""Queries over the message log: decoding, names, selection, summaries, sets, folds and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog import dimensions
from terralog.functions import names, stamps
from terralog.functions.binary import base64_text
from terralog.functions.numeric import sanitize, whole_div
from terralog.functions.radio import dedup_key
from terralog.operators import gates, joins, log, quality
from terralog.operators.ordered import in_sequence
from terralog.plans.registry import query, sql
from terralog.plans.views import Tables, whole


# --- envelopes and names -------------------------------------------------------------------------------------------------

_DECODED = """
    SELECT session_id, row_id, regexp_replace(CASE WHEN coalesce(data::JSON->>'topic', '') <> '' THEN data::JSON->>'topic' ELSE topic END, '^/legacy(/|$)', '/mapping\\1') AS topic,
           coalesce(CAST(data::JSON->>'$.msg.header.stamp.sec' AS BIGINT) * 1000000000 + CAST(data::JSON->>'$.msg.header.stamp.nanosec' AS BIGINT),
                    CAST(data::JSON->>'$.msg.transforms[0].header.stamp.sec' AS BIGINT) * 1000000000 + CAST(data::JSON->>'$.msg.transforms[0].header.stamp.nanosec' AS BIGINT),
                    stamp_ns) AS stamp_ns
    FROM (SELECT * FROM S_env WHERE json_valid(data)) v
    WHERE json_type(data::JSON) = 'OBJECT' AND (data::JSON->>'op' IS NULL OR data::JSON->>'op' = 'publish') AND json_type(data::JSON->'msg') = 'OBJECT'"""


@query("B1 B6", sql(_DECODED, "S_env"))
def decoded_envelopes(t: Tables) -> DataFrame:
    return log.decode_envelope(t.envelopes()).select("session_id", "row_id", "topic", "stamp_ns")


@query("B1", sql("""
    SELECT row_id, CASE WHEN NOT json_valid(data) THEN 'payload is not JSON' WHEN json_type(data::JSON) <> 'OBJECT' THEN 'payload is not an object'
        WHEN data::JSON->>'op' <> 'publish' THEN 'unsupported op ' || (data::JSON->>'op') ELSE 'payload has no object msg' END AS error
    FROM S_env WHERE row_id % 8 IN (3, 4, 5, 6)""", "S_env"))
def rejected_envelopes(t: Tables) -> DataFrame:
    return log.envelope_rejects(t.envelopes()).select("row_id", "error")


_RAW_NAMES = """
    SELECT event_id AS row_id, CASE event_id % 3 WHEN 0 THEN '/legacy/' WHEN 1 THEN '/legacyx/' ELSE '/legacy' END || CASE WHEN event_id % 3 = 2 THEN '' ELSE event_type END AS topic,
           CASE event_id % 4 WHEN 0 THEN 'legacy_msgs/Pose' WHEN 1 THEN 'legacy_msgs/msg/Pose' WHEN 2 THEN 'std_msgs/String' ELSE 'legacy_msgs' END AS type
    FROM events"""


def _raw_names(t: Tables) -> DataFrame:
    e = F.col("event_id")
    root = F.when(e % 3 == 0, "/legacy/").when(e % 3 == 1, "/legacyx/").otherwise("/legacy")
    kind = F.when(e % 4 == 0, "legacy_msgs/Pose").when(e % 4 == 1, "legacy_msgs/msg/Pose").when(e % 4 == 2, "std_msgs/String").otherwise("legacy_msgs")
    return t.table("events").select(e.alias("row_id"), F.concat(root, F.when(e % 3 == 2, "").otherwise(F.col("event_type"))).alias("topic"), kind.alias("type"))


@query("B2", f"""
    SELECT row_id, regexp_replace(topic, '^/legacy(/|$)', '/mapping\\1') AS topic,
           regexp_replace(CASE WHEN len(string_split(type, '/')) = 2 THEN split_part(type, '/', 1) || '/msg/' || split_part(type, '/', 2) ELSE type END, '^legacy_msgs(/|$)', 'mapping_msgs\\1') AS type
    FROM ({_RAW_NAMES})""")
def rewritten_names(t: Tables) -> DataFrame:
    return log.rewrite_names(_raw_names(t), "/legacy", "/mapping", "legacy_msgs", "mapping_msgs")


@query("B3", sql("""
    SELECT row_id, topic, CASE topic WHEN '/view' THEN 'a_msgs/msg/View' WHEN '/click' THEN 'a_msgs/msg/Click' ELSE 'raw' || topic END AS type FROM S_msg""", "S_msg"))
def overridden_types(t: Tables) -> DataFrame:
    typed = t.msg().select("row_id", "topic", F.concat(F.lit("raw"), "topic").alias("type"))
    return log.override_types(typed, {"/view": "a_msgs/msg/View", "/click": "a_msgs/msg/Click"})


@query("B4", sql("SELECT row_id, topic, stamp_ns FROM S_msg WHERE topic IN ('/view', '/error')", "S_msg"))
def selected_topics(t: Tables) -> DataFrame:
    return log.select_topics(t.msg(), ["/view", "/error"]).select("row_id", "topic", "stamp_ns")


@query("B5 G2", "SELECT topic, min(pos) AS position FROM (SELECT trim(split_part(p_name || '#' || p_brand, '#', 1)) AS topic, p_partkey AS pos FROM part) GROUP BY topic")
def topics_in_first_order(t: Tables) -> DataFrame:
    """Names before the ``#`` of each line, each at its first position."""
    lines = t.table("part").select(F.trim(F.substring_index(F.concat("p_name", F.lit("#"), "p_brand"), "#", 1)).alias("topic"), F.col("p_partkey").alias("pos"))
    return log.ordered_distinct(lines, "topic", ["pos"]).select("topic", F.col("position.pos").alias("position"))


@query("B7", """
    SELECT event_id AS row_id, CAST(trunc(s) AS BIGINT) AS sec, CAST(trunc((s - trunc(s)) * 1e9) AS BIGINT) // 1000 AS micros
    FROM (SELECT event_id, 1700000000e0 - 5000e0 + (event_id + value / 1000e0) AS s FROM events)""")
def uptime_stamps(t: Tables) -> DataFrame:
    seconds = stamps.uptime_to_epoch(F.lit(1700000000.0), F.lit(5000.0), F.col("event_id") + F.col("value") / F.lit(1000.0))
    split = t.table("events").select(F.col("event_id").alias("row_id"), stamps.split_stamp(seconds).alias("s"))
    return split.select("row_id", "s.sec", whole_div(F.col("s.nanosec"), 1000).alias("micros"))


def _fix_text() -> Column:
    """Fix messages with numbers as text and missing fields, and five ways to be wrong."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    latitude = F.when(e % 10 == 9, F.lit('"north"')).when(e % 10 == 8, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
    header = F.when(e % 10 == 7, F.lit("5")).otherwise(F.concat(F.lit('{"stamp":{"sec":"'), n, F.lit('"},"frame_id":"f'), (e % 3).cast("string"), F.lit('"}')))
    covariance = F.when(e % 10 == 6, "[1.5,2]").when(e % 10 == 5, "7").otherwise('[1,"2",3,4,5,6,7,8,9.5]')
    status = F.when(e % 10 == 4, F.lit('{"status":300}')).otherwise(F.concat(F.lit('{"service":'), (e % 5).cast("string"), F.lit("}")))
    return F.concat(F.lit('{"header":'), header, F.lit(',"latitude":'), latitude, F.lit(',"unknown":[1],"status":'), status, F.lit(',"position_covariance":'), covariance, F.lit("}"))


@query("B8", """
    SELECT event_id AS row_id, 'f' || (event_id % 3) AS frame_id, event_id AS sec, CAST(0 AS BIGINT) AS nanosec, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS latitude,
           CAST(0 AS BIGINT) AS longitude, CAST(event_id % 5 AS BIGINT) AS service, '1.0,2.0,3.0,4.0,5.0,6.0,7.0,8.0,9.5' AS covariances
    FROM events WHERE event_id % 10 < 4""")
def typed_fixes(t: Tables) -> DataFrame:
    rows = t.table("events").select(F.col("event_id").alias("row_id"), _fix_text().alias("msg"))
    m = F.col("message")
    return log.hydrate_good(rows, "sensor_msgs/msg/NavSatFix").select(
        "row_id", m["header"]["frame_id"].alias("frame_id"), m["header"]["stamp"]["sec"].alias("sec"), m["header"]["stamp"]["nanosec"].alias("nanosec"),
        F.floor(m["latitude"] * 100 + F.lit(0.5)).alias("latitude"), F.floor(m["longitude"]).alias("longitude"), m["status"]["service"].alias("service"),
        F.array_join(m["position_covariance"].cast("array<string>"), ",").alias("covariances"),
    )


_FIX, _IMAGE, _STATS = "sensor_msgs/msg/NavSatFix", "sensor_msgs/msg/CompressedImage", "mapping_msgs/msg/PublisherStats"


def _conversion(t: Tables) -> DataFrame:
    """A log of three known types and an unknown one, under old names, with bad envelopes and bad fields."""
    e = F.col("event_id")
    kind = e % 4
    topic = F.when(kind == 0, "/legacy/fix").when(kind == 1, "/legacy/image").when(kind == 2, "/legacy/stats").otherwise("/legacy/other")
    type_ = F.when(kind == 0, "sensor_msgs/NavSatFix").when(kind == 1, _IMAGE).when(kind == 2, "legacy_msgs/PublisherStats").otherwise("std_msgs/msg/String")
    image = F.when(e % 3 == 0, '{"format":"jpeg","data":"***"}').otherwise('{"format":"jpeg","data":[104,105]}')
    stats = F.format_string('{"depth":%d,"sent_messages":"%d"}', F.when(e % 5 == 0, -1).otherwise(e % 7), e)
    msg = F.when(kind == 0, _fix_text()).when(kind == 1, image).when(kind == 2, stats).otherwise("{}")
    op = F.when(e % 13 == 0, "subscribe").otherwise("publish")
    data = F.when(e % 17 == 0, "not json").otherwise(F.concat(F.lit('{"op":"'), op, F.lit('","msg":'), msg, F.lit("}")))
    rows = t.table("events").select(e.alias("row_id"), topic.alias("topic"), type_.alias("type"), (e * 7).alias("stamp_ns"), data.alias("data"))
    wanted = log.topic_list(t.spark, ["/mapping/fix", "/mapping/image"], ["/mapping/other"], extra=["/mapping/stats", "/mapping/fix"])
    return log.convert(rows, [_FIX, _IMAGE, _STATS], wanted, {"/mapping/image": _IMAGE})


_CONVERTED = """
    SELECT event_id AS e, event_id % 4 AS kind, CASE event_id % 4 WHEN 0 THEN '/mapping/fix' WHEN 1 THEN '/mapping/image' WHEN 2 THEN '/mapping/stats' ELSE '/mapping/other' END AS topic,
           CASE WHEN kind = 3 THEN 'no schema for std_msgs/msg/String' WHEN e % 17 = 0 THEN 'payload is not JSON' WHEN e % 13 = 0 THEN 'unsupported op subscribe'
                WHEN kind = 0 AND e % 10 >= 4 THEN 'fields do not fit sensor_msgs/msg/NavSatFix' WHEN kind = 1 AND e % 3 = 0 THEN 'fields do not fit sensor_msgs/msg/CompressedImage'
                WHEN kind = 2 AND e % 5 = 0 THEN 'fields do not fit mapping_msgs/msg/PublisherStats' END AS reason, value FROM events"""


@query("A5 B1 B2 B3 B4 B5 B6 B8 C11", f"""
    SELECT e AS row_id, topic, CASE kind WHEN 0 THEN 'sensor_msgs/msg/NavSatFix' WHEN 1 THEN 'sensor_msgs/msg/CompressedImage' ELSE 'mapping_msgs/msg/PublisherStats' END AS type,
           e * 7 AS stamp_ns, CASE kind WHEN 0 THEN 'f' || (e % 3) WHEN 1 THEN 'aGk=' ELSE e::VARCHAR END AS shown FROM ({_CONVERTED}) WHERE reason IS NULL""")
def converted_log(t: Tables) -> DataFrame:
    """What converts, with one field of each type."""
    shown = F.coalesce(F.get_json_object("message", "$.header.frame_id"), F.get_json_object("message", "$.sent_messages"))
    text = F.when(F.col("type") == _IMAGE, F.get_json_object("message", "$.data")).otherwise(shown)
    return log.converted(_conversion(t)).select("row_id", "topic", "type", "stamp_ns", text.alias("shown"))


@query("A5 B1 B8 C11", f"SELECT topic, reason, count(*) AS messages FROM ({_CONVERTED}) WHERE reason IS NOT NULL GROUP BY ALL")
def conversion_rejects(t: Tables) -> DataFrame:
    return log.rejected(_conversion(t))


@query("B48 B40", """
    SELECT page_id, regexp_matches(lower(u), '^wss?://[^/?#:@]') AS valid, array_to_string(list_distinct_ordered, '|') AS parts
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'http://', 'ws://') WHEN 1 THEN replace(url, 'http://', 'WSS://') WHEN 2 THEN url ELSE 'ws:///none' END AS u,
                 list_filter(list_transform(string_split_regex(replace(url, '/', ' ; '), '[,;\n]'), lambda x: trim(x)), lambda x: x <> '') AS items,
                 list_filter(items, lambda x, i: list_position(items, x) = i) AS list_distinct_ordered FROM pages)""")
def configured_texts(t: Tables) -> DataFrame:
    p, url = F.col("page_id"), F.col("url")
    address = (
        F.when(p % 4 == 0, F.replace(url, F.lit("http://"), F.lit("ws://"))).when(p % 4 == 1, F.replace(url, F.lit("http://"), F.lit("WSS://")))
        .when(p % 4 == 2, url).otherwise("ws:///none")
    )
    parts = names.split_config(F.replace(url, F.lit("/"), F.lit(" ; ")))
    return t.table("pages").select("page_id", names.valid_recorder_url(address).alias("valid"), F.array_join(parts, "|").alias("parts"))


# --- summaries -----------------------------------------------------------------------------------------------------------

_FILES = "SELECT session_id, chunk, count(*) AS messages, arg_min(stamp_ns, row_id) AS start_ns, arg_max(stamp_ns, row_id) AS end_ns FROM S_msg GROUP BY ALL"


@query("D1 B49", sql(f"""
    SELECT session_id, CAST(sum(messages) AS BIGINT) AS messages, count(*) AS files, min(start_ns) AS start_ns, max(end_ns) AS end_ns,
           greatest(0, max(end_ns) - min(start_ns)) AS duration_ns
    FROM ({_FILES}) GROUP BY session_id""", "S_msg"))
def bag_summary(t: Tables) -> DataFrame:
    return log.bag_summary(t.msg())


@query("D1", sql(f"SELECT *, greatest(0, end_ns - start_ns) AS duration_ns FROM ({_FILES})", "S_msg"))
def bag_files(t: Tables) -> DataFrame:
    return log.bag_files(t.msg())


@query("D1 F5", sql("SELECT session_id, topic, count(*) AS messages, row_number() OVER (ORDER BY session_id, topic) AS position FROM S_msg GROUP BY session_id, topic", "S_msg"))
def bag_topics(t: Tables) -> DataFrame:
    return in_sequence(log.ordered_by_name(log.bag_topics(t.msg()), "session_id", "topic"))


@query("D2 E10 B49", sql("""
    SELECT session_id, count(*) AS messages, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics, min(stamp_ns) AS start_ns, max(stamp_ns) AS end_ns,
           arg_min(row_id, stamp_ns * 1 + 0) FILTER (WHERE topic = '/view') AS first_image,
           list_sort(list(DISTINCT topic))[1] || ', ' || list_sort(list(DISTINCT topic))[2] || ' +' || (count(DISTINCT topic) - 2) AS summary
    FROM S_msg GROUP BY session_id""", "S_msg"))
def session_preview(t: Tables) -> DataFrame:
    rows = t.msg().withColumn("data", F.col("row_id"))
    out = log.session_preview(rows, ["/view"])
    return out.withColumn("summary", names.topic_summary(F.col("topics"))).withColumn("topics", F.array_join("topics", ","))


@query("E10", sql("SELECT session_id, min(stamp_ns) AS stamp_ns, arg_min(row_id, stamp_ns) AS row_id, '/view' AS topic FROM S_msg WHERE topic = '/view' GROUP BY session_id", "S_msg"))
def first_image(t: Tables) -> DataFrame:
    return log.first_image(t.msg().withColumn("data", F.lit("")), ["/view"]).drop("data")


@query("A7 C11", sql("""
    SELECT topic, 't' || topic AS type, count(*) AS messages, count(DISTINCT chunk) AS chunks, CASE WHEN topic IN ('/view', '/click', '/error') THEN 'convert' ELSE 'skip' END AS action
    FROM S_msg GROUP BY topic""", "S_msg"))
def dry_run(t: Tables) -> DataFrame:
    typed = t.msg().withColumn("type", F.concat(F.lit("t"), "topic"))
    known = t.table("events").select(F.concat(F.lit("t/"), "event_type").alias("type")).filter("type in ('t/view', 't/click', 't/error')")
    return log.inspect(typed, known)


@query("D5 I8", sql("""
    SELECT session_id, topic, messages, bytes, CAST(floor(messages / elapsed * 1e9 + 0.5e0) AS BIGINT) AS nano_hz, CAST(floor(bytes * 8 / elapsed * 1e3 + 0.5e0) AS BIGINT) AS milli_bps,
           CAST(floor(messages / elapsed * 1e3 + 0.5e0) AS BIGINT) AS rate_milli_hz, CAST(floor(bytes * 8 / 1e6 / elapsed * 1e3 + 0.5e0) AS BIGINT) AS kilobit
    FROM (SELECT session_id, topic, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes, (max(stamp_ns) - min(stamp_ns)) / 1e9 AS elapsed FROM S_msg GROUP BY ALL)""", "S_msg"))
def topic_rates(t: Tables) -> DataFrame:
    out = log.topic_rates(t.msg())
    exact = F.floor(F.col("messages") / F.col("elapsed_s") * F.lit(1e9) + F.lit(0.5)).alias("nano_hz")
    return out.select("session_id", "topic", "messages", "bytes", exact, F.floor(F.col("bytes") * 8 / F.col("elapsed_s") * F.lit(1e3) + F.lit(0.5)).alias("milli_bps"), whole(F.col("rate_hz") * 1000).alias("rate_milli_hz"), whole(F.col("mbps") * 1000).alias("kilobit"))


@query("E9", sql("""
    SELECT m.session_id, chunk, topic_id, topic FROM (SELECT DISTINCT session_id, chunk, topic FROM S_msg) m
    JOIN (SELECT session_id, topic, row_number() OVER (PARTITION BY session_id ORDER BY first) AS topic_id
          FROM (SELECT session_id, topic, min(row_id) AS first FROM S_msg GROUP BY ALL)) n USING (session_id, topic)""", "S_msg"))
def topic_ids(t: Tables) -> DataFrame:
    return log.topic_ids(t.msg())


@query("F1", sql("SELECT stamp_ns, chunk, row_id, topic, row_number() OVER (ORDER BY stamp_ns, chunk, row_id) AS position FROM S_msg", "S_msg"))
def merged_chunks(t: Tables) -> DataFrame:
    return in_sequence(log.merge_chunks(t.msg()).select("stamp_ns", "chunk", "row_id", "topic"))


@query("F4", sql(f"SELECT session_id, min(start_ns) AS start_ns, row_number() OVER (ORDER BY min(start_ns) DESC, session_id) AS position FROM ({_FILES}) GROUP BY session_id", "S_msg"))
def recent_sessions(t: Tables) -> DataFrame:
    return in_sequence(log.recent_sessions(log.bag_summary(t.msg())).select("session_id", "start_ns"))


@query("G1", """
    SELECT CAST(bag AS BIGINT) AS bag, topic, count(*) AS messages, CASE WHEN topic = '/view' THEN 'later' ELSE 'earlier' END AS type
    FROM (SELECT 0 AS bag, '/' || event_type AS topic FROM events UNION ALL SELECT 1, '/' || event_type FROM events WHERE event_type = 'view') GROUP BY ALL""")
def united_bags(t: Tables) -> DataFrame:
    first = t.msg().select("topic", "chunk", F.lit("earlier").alias("type"))
    second = first.filter("topic = '/view'").withColumn("type", F.lit("later"))
    both = log.union_bags(first, second)
    types = log.final_topic_types(both)
    return both.groupBy("bag", "topic").agg(F.count("*").alias("messages")).join(types, "topic").select(F.col("bag").cast("bigint").alias("bag"), "topic", "messages", "type")


@query("G6 J2", sql("""
    WITH M AS (SELECT * FROM S_msg WHERE NOT (session_id % 2 = 0 AND topic = '/click'))
    SELECT s.session_id, r.topic FROM (SELECT DISTINCT session_id FROM M) s CROSS JOIN (SELECT unnest(['/view', '/click', '/imu', '/purchase']) AS topic) r
    WHERE NOT EXISTS (SELECT 1 FROM M WHERE M.session_id = s.session_id AND M.topic = r.topic)""", "S_msg"))
def missing_topics(t: Tables) -> DataFrame:
    rows = t.msg().filter("not (session_id % 2 = 0 and topic = '/click')")
    return log.missing_topics(["/view", "/click", "/imu", "/purchase"], rows)


# --- joins on the log ----------------------------------------------------------------------------------------------------


@query("C1", sql("""
    SELECT row_id, m.topic AS name FROM S_msg m""", "S_msg"))
def messages_with_topic(t: Tables) -> DataFrame:
    """Messages carry only a topic id that is local to their chunk; names come from the chunk's topic table."""
    rows = t.msg()
    ids = rows.groupBy("chunk", "topic").agg(F.min("row_id").alias("topic_id"))
    stored = rows.join(ids, ["chunk", "topic"]).select("chunk", "topic_id", "row_id")
    return joins.with_topic(stored, ids.withColumnRenamed("topic", "name")).select("row_id", "name")


@query("C4", sql("""
    SELECT a.session_id, a.stamp_ns // 1800000000000 AS half_hour, count(*) AS pairs
    FROM (SELECT DISTINCT session_id, stamp_ns // 1800000000000 * 1800000000000 AS stamp_ns FROM S_msg WHERE topic = '/view') a
    JOIN (SELECT DISTINCT session_id, stamp_ns // 1800000000000 * 1800000000000 AS stamp_ns FROM S_msg WHERE topic = '/click') b
    ON a.session_id = b.session_id AND a.stamp_ns = b.stamp_ns GROUP BY ALL""", "S_msg"))
def stamped_pairs(t: Tables) -> DataFrame:
    """Image and camera messages of the same (half-hour) stamp."""
    half = whole_div(F.col("stamp_ns"), 1_800_000_000_000) * 1_800_000_000_000
    rows = t.msg().select("session_id", "topic", half.alias("stamp_ns")).distinct()
    paired = joins.pair_stamp(rows.filter("topic = '/view'").drop("topic"), rows.filter("topic = '/click'").drop("topic"))
    return paired.groupBy("session_id", whole_div(F.col("stamp_ns"), 1_800_000_000_000).alias("half_hour")).agg(F.count("*").alias("pairs"))


@query("C10 A13", """
    SELECT topic, count(*) AS messages FROM (SELECT CASE user_id % 6 WHEN 0 THEN '/mapping/pose' WHEN 1 THEN '/mapping/imu' WHEN 2 THEN '/mapping/gps/fix'
        WHEN 3 THEN '/mapping/surfels' WHEN 4 THEN '/mapping/dem/tile' ELSE '/mapping/odom' END AS topic FROM events)
    WHERE topic IN ('/mapping/pose', '/mapping/gps/fix', '/mapping/dem/tile') GROUP BY topic""")
def messages_on_enabled_topics(t: Tables) -> DataFrame:
    topics = ["/mapping/pose", "/mapping/imu", "/mapping/gps/fix", "/mapping/surfels", "/mapping/dem/tile", "/mapping/odom"]
    listed = F.array(*[F.lit(x) for x in topics])
    rows = t.table("events").select(F.element_at(listed, (F.col("user_id") % 6 + 1).cast("int")).alias("topic"))
    dims = dimensions.load_dimensions(t.spark)
    streams = t.spark.createDataFrame([(s,) for s in dimensions.DEFAULT_STREAMS], "stream string")
    enabled = joins.enabled_topics(dims["topics"], streams)
    return rows.join(F.broadcast(enabled.select("topic")), "topic", "left_semi").groupBy("topic").agg(F.count("*").alias("messages"))


@query("C12 B38", sql("""
    SELECT kind, count(*) AS fresh FROM S_radio r WHERE NOT EXISTS (SELECT 1 FROM S_radio p WHERE p.seq % 3 = 0 AND p.source = r.source AND p.kind = r.kind AND p.stamp_ns // 1000 = r.stamp_ns // 1000) GROUP BY kind""", "S_radio"))
def unpublished_radio(t: Tables) -> DataFrame:
    key = dedup_key(F.lit("ble_advertisement"), F.col("kind"), F.col("source").cast("string"), F.col("stamp_ns") / F.lit(1e9))
    rows = t.radio().withColumn("dedup_key", key)
    return joins.unpublished(rows, rows.filter("seq % 3 = 0")).groupBy("kind").agg(F.count("*").alias("fresh"))


# --- gates ---------------------------------------------------------------------------------------------------------------


@query("E1", sql("""
    WITH RECURSIVE chain AS (
        SELECT source, min(stamp_ns) AS stamp_ns FROM S_msg GROUP BY source
        UNION ALL
        SELECT c.source, (SELECT min(m.stamp_ns) FROM S_msg m WHERE m.source = c.source AND m.stamp_ns >= c.stamp_ns + 43200000000000) FROM chain c
        WHERE c.stamp_ns IS NOT NULL)
    SELECT source, count(stamp_ns) AS kept, CAST(sum(stamp_ns // 1000000000) AS BIGINT) AS seconds FROM chain WHERE stamp_ns IS NOT NULL GROUP BY source""", "S_msg"))
def rate_gated(t: Tables) -> DataFrame:
    kept = gates.rate_gate(t.msg().select("source", "stamp_ns", "row_id"), ["source"], 43_200_000_000_000)
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.sum(whole_div(F.col("stamp_ns"), 1_000_000_000)).alias("seconds"))


@query("E8", sql("""
    WITH RECURSIVE ends AS MATERIALIZED (SELECT session_id, row_id, bytes, row_number() OVER w AS i, CAST(sum(bytes) OVER w AS BIGINT) AS e
                         FROM S_msg WINDOW w AS (PARTITION BY session_id ORDER BY row_id)),
    chain AS (
        SELECT session_id, CAST(0 AS BIGINT) AS chunk, CAST(1 AS BIGINT) AS i FROM ends GROUP BY session_id
        UNION ALL
        SELECT c.session_id, c.chunk + 1, (SELECT min(n.i) FROM ends n, ends s WHERE n.session_id = c.session_id AND s.session_id = c.session_id AND s.i = c.i AND n.i > c.i AND n.e > s.e - s.bytes + 500000)
        FROM chain c WHERE c.i IS NOT NULL)
    SELECT session_id, chunk, min(row_id) AS first_row, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM (SELECT e.*, c.chunk FROM ends e ASOF JOIN (SELECT * FROM chain WHERE i IS NOT NULL) c ON e.session_id = c.session_id AND e.i >= c.i) GROUP BY ALL""", "S_msg"))
def rotated_chunks(t: Tables) -> DataFrame:
    rows = gates.assign_chunks(t.msg().select("session_id", "row_id", "bytes"), 500_000)
    return rows.groupBy("session_id", "chunk").agg(F.min("row_id").alias("first_row"), F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))


# --- checks --------------------------------------------------------------------------------------------------------------


@query("J1", sql("""
    SELECT session_id, topic, messages, abs(floor(messages / elapsed * 1e3 + 0.5e0) / 1e3 - target) <= target * 0.1e0 AS ok
    FROM (SELECT session_id, topic, count(*) AS messages, (max(stamp_ns) - min(stamp_ns)) / 1e12 AS elapsed, CASE topic WHEN '/view' THEN 0.1e0 ELSE 0.2e0 END AS target
          FROM S_msg WHERE topic IN ('/view', '/click') GROUP BY ALL)
    UNION ALL SELECT DISTINCT session_id, '/silent', CAST(0 AS BIGINT), false FROM S_msg""", "S_msg"))
def checked_rates(t: Tables) -> DataFrame:
    # log time runs 1000 times slower, so that the rates are in the range of a recording
    rows = t.msg().withColumn("stamp_ns", F.col("stamp_ns") / F.lit(1000.0))
    return quality.check_rates(rows, {"/view": 0.1, "/click": 0.2, "/silent": 1.0}).select("session_id", "topic", "messages", "ok")


@query("J2", sql("""
    SELECT session_id, '/imu' AS topic, 'missing' AS problem FROM S_msg GROUP BY session_id
    UNION ALL SELECT DISTINCT session_id, topic, 'unknown type' FROM S_msg WHERE topic IN ('/signup', '/purchase')""", "S_msg"))
def checked_topics(t: Tables) -> DataFrame:
    typed = t.msg().withColumn("type", F.concat(F.lit("t"), "topic"))
    known = t.table("events").select(F.concat(F.lit("t/"), "event_type").alias("type")).filter("type in ('t/view', 't/click', 't/error')")
    return quality.check_topics(typed, ["/view", "/imu"], known)


@query("J3 B9", """
    SELECT topic, field, CAST(n AS BIGINT) AS non_finite FROM (
        SELECT event_type AS topic, unnest(['a', 'b']) AS field, unnest([count(*) FILTER (WHERE event_id % 17 = 0), count(*) FILTER (WHERE event_id % 23 = 0)]) AS n FROM events GROUP BY event_type)""")
def checked_finite(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    rows = t.table("events").select(
        F.col("event_type").alias("topic"), F.when(e % 17 == 0, F.lit(float("nan"))).otherwise(v).alias("a"), F.when(e % 23 == 0, F.lit(float("-inf"))).otherwise(v).alias("b")
    )
    return quality.check_finite(rows, ["a", "b"])


@query("B9", """
    SELECT event_id AS row_id, CASE WHEN event_id % 17 = 0 THEN -100 ELSE CAST(floor(value * 100 + 0.5e0) AS BIGINT) END AS accuracy,
           CASE WHEN event_id % 23 = 0 THEN 0 ELSE CAST(floor(value * 100 + 0.5e0) AS BIGINT) END AS latitude FROM events""")
def sanitized_readings(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    rows = t.table("events").select(
        e.alias("row_id"), F.when(e % 17 == 0, F.lit(float("nan"))).otherwise(v).alias("accuracy"), F.when(e % 23 == 0, F.lit(float("inf"))).otherwise(v).alias("latitude")
    )
    clean = sanitize(rows, {"accuracy": -1.0, "latitude": 0.0})
    return clean.select("row_id", *[F.floor(F.col(c) * 100 + F.lit(0.5)).alias(c) for c in ("accuracy", "latitude")])


@query("J4", sql("""
    SELECT session_id, topic, count(*) AS messages, count(*) FILTER (WHERE stamp_ns < b) AS backward_steps,
           CAST(floor((regr_slope((recv_ns - 1700000000000000000) / 1e9, (stamp_ns - 1700000000000000000) / 1e9) - 1) * 1e6 + 0.371931e0) AS BIGINT) AS drift
    FROM (SELECT session_id, topic, recv_ns, stamp_ns - (row_id % 7) * 400000000000 AS stamp_ns,
                 lag(stamp_ns - (row_id % 7) * 400000000000) OVER (PARTITION BY session_id, topic ORDER BY row_id) AS b FROM S_msg) GROUP BY ALL""", "S_msg"))
def checked_clock(t: Tables) -> DataFrame:
    rows = t.msg().withColumn("stamp_ns", F.col("stamp_ns") - (F.col("row_id") % 7) * 400_000_000_000)
    return quality.check_clock(rows).select("session_id", "topic", "messages", "backward_steps", F.floor(F.col("drift") * F.lit(1e6) + F.lit(0.371931)).alias("drift"))


@query("J5", sql("""
    SELECT session_id, topic, CASE WHEN topic = '/error' THEN 0 ELSE n END AS stated, n AS found, topic <> '/error' AS ok
    FROM (SELECT session_id, topic, count(*) AS n FROM S_msg GROUP BY ALL)""", "S_msg"))
def checked_counts(t: Tables) -> DataFrame:
    found = log.bag_topics(t.msg())
    return quality.check_counts(found.filter("topic <> '/error'"), found)


@query("J7", sql("""
    SELECT session_id, 'buffer bytes' AS limit_name, CAST(1 AS BIGINT) AS times FROM S_msg GROUP BY session_id HAVING sum(bytes) >= 20000000
    UNION ALL SELECT session_id, 'queue depth', count(*) FROM S_msg WHERE row_id % 130 >= 120 GROUP BY session_id
    UNION ALL SELECT session_id, 'buffer samples', count(*) FROM S_msg WHERE (row_id % 2 = 0 AND row_id % 40 >= 30) OR (row_id % 2 = 1 AND row_id % 40 >= 5) GROUP BY session_id""", "S_msg"))
def checked_limits(t: Tables) -> DataFrame:
    rows = t.msg()
    queues = rows.select("session_id", (F.col("row_id") % 130).alias("depth"))
    buffers = rows.select("session_id", F.when(F.col("row_id") % 2 == 0, "cloud").otherwise("mesh").alias("kind"), (F.col("row_id") % 40).alias("samples"), "bytes")
    return quality.check_limits(t.points().select("session_id", "frame"), queues, buffers)


@query("A13", """
    SELECT topic, sum(is_implemented::BIGINT)::BIGINT AS implemented FROM (SELECT '/mapping/pose' AS topic, user_id < 0 OR true AS is_implemented FROM events
    UNION ALL SELECT '/mapping/surfels', false FROM events) GROUP BY topic""")
def implemented_messages(t: Tables) -> DataFrame:
    dims = dimensions.load_dimensions(t.spark)
    both = F.explode(F.array(F.lit("/mapping/pose"), F.lit("/mapping/surfels")))
    rows = t.table("events").select(both.alias("topic"))
    return rows.join(F.broadcast(dims["topics"]), "topic").groupBy("topic").agg(F.sum(F.col("is_implemented").cast("bigint")).alias("implemented"))


@query("B52", f"""
    SELECT event_id AS row_id, octet_length(encode('img' || event_id)) AS bytes FROM events WHERE event_id % 3 <> 2""")
def jpeg_payloads(t: Tables) -> DataFrame:
    e = F.col("event_id")
    formats = F.when(e % 3 == 0, "JPEG").when(e % 3 == 1, "rgb8; jpg compressed").otherwise("png")
    rows = t.table("events").select(e.alias("row_id"), formats.alias("format"), base64_text(F.concat(F.lit("img"), e.cast("string")).cast("binary")).alias("data"))
    return log.jpeg_payload(rows).select("row_id", F.octet_length("image").cast("bigint").alias("bytes"))


