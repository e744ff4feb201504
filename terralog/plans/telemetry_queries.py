"""Queries over telemetry: sizes, counters, sessions, health and radio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions import health, radio, stamps
from terralog.functions.names import topic_summary
from terralog.functions.numeric import quantize
from terralog.operators import joins, log, telemetry
from terralog.operators.ordered import BUCKET_ROWS
from terralog.plans.registry import query, sql
from terralog.plans.views import Tables, whole


def _q(expression: str, scale: str = "1e4") -> str:
    return f"CAST(floor(({expression}) * {scale} + 0.5e0) AS BIGINT)"


# --- sizes and counters --------------------------------------------------------------------------------------------------


@query("D3 I7", sql(f"""
    SELECT stream, count(*) AS message_count, CAST(sum(greatest(0, original_bytes)) AS BIGINT) AS original_bytes_total, CAST(sum(greatest(0, encoded_bytes)) AS BIGINT) AS encoded_bytes_total,
           max(greatest(0, encoded_bytes)) AS max_encoded_bytes, arg_max(greatest(0, original_bytes), (seq, original_bytes)) AS last_original_bytes,
           {_q('sum(greatest(0, encoded_bytes)) / sum(greatest(0, original_bytes))', '1e9')} AS ratio
    FROM S_payload GROUP BY stream""", "S_payload"))
def payload_metrics(t: Tables) -> DataFrame:
    rows = t.payloads().withColumn("seq", F.struct("seq", "original_bytes"))
    out = telemetry.payload_metrics(rows)
    return out.select("stream", "message_count", "original_bytes_total", "encoded_bytes_total", "max_encoded_bytes", "last_original_bytes", quantize(F.col("compression_ratio"), 1e9).alias("ratio"))


@query("B55 B42", """
    SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS BIGINT) * 16 WHEN 1 THEN 8 WHEN 2 THEN CAST(l_quantity AS BIGINT) * 12 ELSE l_partkey END AS original_bytes,
           CASE l_linenumber % 4 WHEN 0 THEN octet_length(encode(l_returnflag || l_linestatus)) WHEN 3 THEN l_suppkey
             ELSE octet_length(encode('{"msg":{"k":' || l_orderkey || ',"t":"' || l_returnflag || '"},"op":"publish","topic":"/mapping/x"}')) END AS encoded_bytes FROM lineitem""")
def payload_sizes(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "cloud").when(n % 4 == 1, "calibration").when(n % 4 == 2, "markers").otherwise("snapshot")
    msg = F.struct(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("t"))
    rows = t.table("lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").alias("p"), kind.alias("kind"), F.col("l_quantity").cast("bigint").alias("points"), F.col("l_partkey").alias("original_bytes"),
        F.concat("l_returnflag", "l_linestatus").alias("data"), radio.publish_bytes(F.lit("/mapping/x"), msg).alias("envelope_bytes"), F.col("l_suppkey").alias("published_bytes"),
    )
    return telemetry.payload_sizes(rows).select("k", "n", "p", "original_bytes", "encoded_bytes")


@query("D4", sql("""
    SELECT session_id, count(*) FILTER (WHERE kind = 'sent') AS sent_messages, count(*) FILTER (WHERE kind = 'dropped') AS dropped_messages, count(*) FILTER (WHERE kind = 'retried') AS retried_messages,
           count(*) FILTER (WHERE kind = 'failed') AS failed_messages, count(*) FILTER (WHERE kind IN ('sent', 'failed')) AS message_count,
           coalesce(arg_max(CASE WHEN kind = 'sent' THEN '' ELSE coalesce(error, '') END, seq) FILTER (WHERE kind = 'sent' OR error IS NOT NULL), '') AS last_error
    FROM S_send GROUP BY session_id""", "S_send"))
def publisher_stats(t: Tables) -> DataFrame:
    return telemetry.publisher_stats(t.sends())


@query("D13", """
    SELECT session_id, count(*) AS probes, count(*) FILTER (WHERE NOT ok) AS failures, CAST(floor(avg(bytes * n / (greatest(ms, 1e0) / 1000e0)) FILTER (WHERE ok) + 0.371931e0) AS BIGINT) AS mean_rate,
           quantile_disc(rtt, 0.5) FILTER (WHERE ok) AS median_ms, quantile_disc(rtt, 0.95) FILTER (WHERE ok) AS p95_ms
    FROM (SELECT o_custkey % 16 AS session_id, o_orderstatus <> 'F' AS ok, 65536 AS bytes, o_orderkey % 8 + 1 AS n, (o_orderkey % 50) / 4e0 AS ms, (o_orderkey % 90) / 2e0 AS rtt FROM orders) GROUP BY session_id""")
def probe_summary(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    rows = t.table("orders").select(
        (F.col("o_custkey") % 16).alias("session_id"), (F.col("o_orderstatus") != "F").alias("success"), F.lit(65536).alias("payload_bytes"), (o % 8 + 1).alias("message_count"),
        ((o % 50) / F.lit(4.0)).alias("elapsed_ms"), ((o % 90) / F.lit(2.0)).alias("rtt_ms"),
    )
    return telemetry.probe_summary(rows).select("session_id", "probes", "failures", F.floor(F.col("mean_rate") + F.lit(0.371931)).alias("mean_rate"), F.col("rtt_ms")[0].alias("median_ms"), F.col("rtt_ms")[1].alias("p95_ms"))


@query("D13", """
    SELECT o_orderkey AS seq, CASE WHEN o_orderstatus <> 'F' THEN CAST(floor(65536e0 * 4 / (greatest((o_orderkey % 50) / 4e0, 1e0) / 1000e0) + 0.371931e0) AS BIGINT) ELSE 0 END AS rate,
           CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey % 90 AS BIGINT) ELSE -1 END AS rtt_ms FROM orders""")
def probe_rates(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    rows = t.table("orders").select(
        o.alias("seq"), (F.col("o_orderstatus") != "F").alias("success"), F.lit(65536.0).alias("payload_bytes"), F.lit(4).alias("message_count"),
        ((o % 50) / F.lit(4.0)).alias("elapsed_ms"), (o % 90).cast("double").alias("rtt_ms"),
    )
    return telemetry.probe_throughput(rows).select("seq", F.floor(F.col("rate") + F.lit(0.371931)).alias("rate"), F.col("rtt_ms").cast("bigint").alias("rtt_ms"))


@query("D14", """
    SELECT p_size AS session_id, CAST(sum(p_partkey) AS BIGINT) AS bytes, CAST(coalesce(sum(p_partkey) FILTER (WHERE p_partkey % 3 = 0), 0) AS BIGINT) AS chunk_bytes,
           count(*) FILTER (WHERE p_partkey % 3 = 0) AS chunks, count(*) AS files FROM part GROUP BY p_size""")
def bytes_by_kind(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "chunk").otherwise("metadata")
    return telemetry.bytes_by_kind(t.table("part").select(F.col("p_size").alias("session_id"), kind.alias("kind"), F.col("p_partkey").alias("bytes")))


@query("D16", sql("""
    SELECT session_id, count(*) FILTER (WHERE row_id % 3 = 0 AND row_id % 2 = 0) AS cloud_samples, count(*) FILTER (WHERE row_id % 3 = 0 AND row_id % 2 = 1) AS mesh_samples,
           CAST(coalesce(sum(bytes) FILTER (WHERE row_id % 3 = 0), 0) AS BIGINT) AS buffered_bytes, count(*) FILTER (WHERE row_id % 3 = 1) AS dropped_samples, count(*) FILTER (WHERE row_id % 3 = 2) AS replayed_samples,
           max(stamp_ns) FILTER (WHERE row_id % 3 = 0) AS last_buffered_ns FROM S_msg GROUP BY session_id""", "S_msg"))
def buffer_stats(t: Tables) -> DataFrame:
    r = F.col("row_id")
    action = F.when(r % 3 == 0, "buffered").when(r % 3 == 1, "dropped").otherwise("replayed")
    rows = t.msg().withColumns({"action": action, "kind": F.when(r % 2 == 0, "cloud").otherwise("mesh"), "ts_ns": F.col("stamp_ns")})
    return telemetry.buffer_stats(rows)


# --- latest, recent, thermal ---------------------------------------------------------------------------------------------


@query("E3", sql("SELECT source, kind, arg_max(seq, (stamp_ns, seq)) AS seq FROM S_radio GROUP BY ALL", "S_radio"))
def latest_samples(t: Tables) -> DataFrame:
    return telemetry.latest_per(t.radio(), ["source", "kind"], ["stamp_ns", "seq"]).select("source", "kind", "seq")


@query("E4", sql("""
    SELECT kind, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY stamp_ns DESC, seq DESC) AS k FROM (
        SELECT kind, source, arg_max(seq, (stamp_ns, seq)) AS seq, max(stamp_ns) AS stamp_ns FROM S_radio GROUP BY ALL)) WHERE k <= 32""", "S_radio"))
def recent_sources(t: Tables) -> DataFrame:
    return telemetry.keep_recent(t.radio(), ["kind"], "source", ["stamp_ns", "seq"], 32).select("kind", "source", "seq")


@query("E15", sql("""
    SELECT session_id, row_id, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 20) AS interval_ms_10
    FROM (SELECT session_id, row_id, CASE row_id % 9 WHEN 4 THEN 10 WHEN 5 THEN 10 WHEN 6 THEN 25 WHEN 7 THEN 50 END AS k FROM S_msg)""", "S_msg"))
def thermal_intervals(t: Tables) -> DataFrame:
    r = F.col("row_id") % 9
    state = F.when(r == 4, "nominal").when(r == 5, "fair").when(r == 6, "serious").when(r == 7, "critical").otherwise("odd")
    rows = t.msg().select("session_id", "row_id", state.alias("state"))
    return telemetry.thermal_interval(rows, ["session_id"], ["row_id"], width=BUCKET_ROWS).select("session_id", "row_id", F.floor(F.col("interval_s") * 100 + F.lit(0.5)).cast("int").alias("interval_ms_10"))


# --- sessions ------------------------------------------------------------------------------------------------------------


@query("E14 I10", sql("""
    SELECT session_id, arg_max(state, seq) AS state, arg_max(event, seq) AS last_event, min(ts_ns) FILTER (WHERE event = 'started') AS started_ns,
           CASE WHEN coalesce(max(seq) FILTER (WHERE event = 'stopped') > max(seq) FILTER (WHERE event = 'started'), max(seq) FILTER (WHERE event = 'started') IS NULL) THEN arg_max(ts_ns, seq) FILTER (WHERE event = 'stopped') END AS ended_ns,
           arg_max(coalesce(last_error, ''), seq) AS last_error, count(*) AS events
    FROM S_session GROUP BY session_id""", "S_session"))
def session_states(t: Tables) -> DataFrame:
    rows = t.session_events().withColumn("last_error", F.coalesce("last_error", F.lit("")))
    return telemetry.session_state(rows).drop("enabled_streams")


@query("B53", sql("""
    SELECT session_id, seq, CASE WHEN seq % 1000 % 2 = 0 THEN 'gps,pose' ELSE 'camera,pose' END AS streams, CASE WHEN seq % 1000 % 2 = 0 THEN 3 ELSE 3 END AS topics,
           '{"sent":' || n || '}' AS publish_queue, metrics, 'current_wifi_network,ble_advertisement,network_path,recorder_latency_probe,external_adapter' AS channels,
           '1,2,1' AS affected, 'copernicus_data_space,open_topography,usgs_eros_earthdata,commercial_imagery,commercial_terrain' AS slots
    FROM S_session JOIN (SELECT session_id, count(*) AS n FROM S_session GROUP BY session_id) USING (session_id)
    JOIN (SELECT session_id, '[' || string_agg('{"stream":"' || event || '","messages":' || k || '}', ',' ORDER BY event) || ']' AS metrics
          FROM (SELECT session_id, event, count(*) AS k FROM S_session GROUP BY ALL) GROUP BY session_id) USING (session_id)""", "S_session"))
def session_documents(t: Tables) -> DataFrame:
    events = t.session_events()
    sent = events.groupBy("session_id").agg(F.count("*").alias("sent"))
    metrics = events.groupBy("session_id", F.col("event").alias("stream")).agg(F.count("*").alias("messages"))
    out = telemetry.session_document(events, metrics, sent)
    topics = F.size(F.from_json("advertised_topics", "array<struct<id:string>>"))

    def ids(section: str, field: str) -> Column:
        return F.array_join(F.from_json(section, f"array<struct<{field}:string>>")[field], ",")

    affected = F.transform(F.from_json("radio_platform_restrictions", "array<struct<affected_channels:array<string>>>")["affected_channels"], lambda c: F.size(c).cast("string"))
    return out.select(
        "session_id", "seq", F.array_join("enabled_streams", ",").alias("streams"), topics.alias("topics"), "publish_queue", F.col("stream_payload_metrics").alias("metrics"),
        ids("radio_channels", "channel_id").alias("channels"), F.array_join(affected, ",").alias("affected"), ids("optional_geo_provider_configurations", "provider_id").alias("slots"),
    )


# --- health --------------------------------------------------------------------------------------------------------------


def ticks(t: Tables) -> DataFrame:
    """One row of readings per event, as the health report reads them."""
    e = F.col("event_id")

    def every(n: int, value: str):
        return F.when(e % n == 0, F.lit(value))

    return t.table("events").select(
        (F.col("user_id") % 16).alias("session_id"), e.alias("tick"), (e % 5 != 0).alias("connected"), (e % 19 == 0).cast("bigint").alias("failed"),
        (e % 7 == 0).cast("bigint").alias("dropped"), (e % 120).alias("depth"), F.lit(120).alias("capacity"), (e % 17 == 0).cast("bigint").alias("buffer_dropped"),
        (e % 100 * 200_000).alias("buffer_bytes"), F.lit(20_000_000).alias("buffer_max_bytes"), (e % 3).alias("buffer_samples"), (e % 2).alias("buffer_replayed"),
        every(13, "disk full").alias("bag_error"), (e % 4 == 0).alias("recording"), (e % 2 == 0).alias("bag_enabled"), (e % 3).alias("metric_streams"),
        every(23, "no tile").alias("tile_error"), F.when(e % 29 == 0, "denied").when(e % 31 == 0, "not_determined").otherwise("authorized_when_in_use").alias("authorization"),
        (e % 37 != 0).alias("running"), (e % 41 != 0).alias("precise"), F.when(e % 6 != 0, (e % 14).cast("double")).alias("age_s"), (e % 40 - 2).cast("double").alias("hacc"),
        (e % 8 != 0).alias("heading_available"), (e % 60 - 2).cast("double").alias("heading_acc"), (e % 12).cast("double").alias("heading_age_s"), every(43, "lost").alias("indoor_error"),
        ((e % 10) / F.lit(10.0)).alias("indoor_quality"), ((e % 9) / F.lit(9.0)).alias("global_quality"), (e % 11 != 0).alias("entitled"),
        F.when(e % 5 != 1, radio.wifi_label((e % 100) / F.lit(100.0))).alias("wifi_label"), every(10, "no network").alias("wifi_error"),
        F.when(e % 47 == 0, "denied").otherwise("allowed").alias("ble_authorization"), F.when(e % 53 == 0, "unsupported").when(e % 9 == 0, "powered_off").otherwise("powered_on").alias("ble_central"),
        (e % 15 != 0).alias("ble_filters"), F.when(e % 4 != 0, -(e % 90)).alias("ble_rssi"), every(8, "scan failed").alias("ble_error"),
        F.when(e % 3 == 0, "satisfied").when(e % 3 == 1, "requires_connection").when(e % 2 == 0, "unsatisfied").alias("path_status"), F.when(e % 2 == 0, "wifi").otherwise("").alias("path_interfaces"),
        F.when(e % 4 == 0, "no route").otherwise("").alias("path_reason"), every(5, "monitor failed").alias("path_error"),
        F.when(e % 5 != 2, e % 5 != 0).alias("probe_success"), F.lit("timeout").alias("probe_error"), (e % 300).cast("double").alias("probe_rtt_ms"), (e % 50 * 1024).cast("double").alias("probe_rate"),
        F.lit(None).cast("string").alias("probe_last_error"),
        # what the statuses show besides
        F.concat(F.lit("ws://h"), (e % 3).cast("string")).alias("recorder_url"), F.when(e % 2 == 0, "gps,pose").otherwise("pose").alias("enabled_streams"), (e % 4).alias("in_flight"),
        (e % 1000).alias("sent"), (e % 6).alias("retried"), every(19, "socket closed").alias("queue_error"), (e % 30).alias("buffer_clouds"), (e % 5).alias("buffer_meshes"),
        F.lit(30).alias("buffer_max_clouds"), F.lit(5).alias("buffer_max_meshes"), every(2, "2024-01-01T00:00:00Z").alias("buffered_at"), (e % 21 != 0).alias("tiles_running"),
        every(3, "2024-01-02T00:00:00Z").alias("tiles_published_at"), F.lit(60).alias("tile_interval_s"),
        F.transform(
            F.slice(F.array(F.lit("camera"), F.lit("lidar")), 1, (e % 3).cast("int")),
            lambda s: F.struct(
                s.alias("stream"), (e % 50).alias("message_count"), (e % 50 * 100).alias("original_bytes_total"), (e % 50 * 40).alias("encoded_bytes_total"), (e % 40).alias("max_encoded_bytes"),
                (e % 39).alias("last_encoded_bytes"), F.lit("zlib").alias("last_compression"), F.lit(2.5).alias("compression_ratio"), F.lit(None).cast("string").alias("last_recorded_at"),
            ),
        ).alias("metrics"),
    )


_LEVELS = """
    SELECT session_id, event_id AS tick, CASE WHEN e % 5 <> 0 THEN 0 ELSE 2 END AS bridge,
      CASE WHEN e % 19 = 0 THEN 2 WHEN e % 7 = 0 OR e % 120 > 96 THEN 1 ELSE 0 END AS queue,
      CASE WHEN e % 17 = 0 OR e % 100 * 200000 > 16000000 THEN 1 ELSE 0 END AS buffer, CASE WHEN e % 13 = 0 THEN 1 ELSE 0 END AS bag, CASE WHEN e % 23 = 0 THEN 1 ELSE 0 END AS tiles,
      CASE WHEN e % 29 = 0 THEN 2 WHEN e % 37 = 0 OR e % 31 = 0 OR e % 41 = 0 OR e % 6 = 0 OR e % 14 > 10 OR e % 40 - 2 < 0 OR e % 40 - 2 > 25 OR e % 8 = 0 OR e % 60 - 2 < 0 OR e % 60 - 2 > 45 OR e % 12 > 10 THEN 1 ELSE 0 END AS gps,
      CASE WHEN e % 43 = 0 OR e % 37 = 0 OR e % 41 = 0 OR (e % 6 <> 0 AND e % 14 > 10) OR e % 10 < 2.5e0 OR e % 9 < 2.25e0 THEN 1 ELSE 0 END AS indoor,
      CASE WHEN e % 37 = 0 OR e % 11 = 0 OR e % 29 = 0 OR e % 31 = 0 OR e % 5 = 1 THEN 1 ELSE 0 END AS wifi,
      CASE WHEN e % 37 = 0 THEN 1 WHEN e % 47 = 0 OR e % 53 = 0 THEN 2 WHEN e % 15 = 0 OR e % 9 = 0 OR e % 4 = 0 THEN 1 ELSE 0 END AS ble,
      CASE WHEN e % 37 = 0 OR (e % 3 = 2 AND e % 2 = 1) THEN 1 WHEN e % 3 = 0 THEN 0 WHEN e % 3 = 1 THEN 1 ELSE 2 END AS path,
      CASE WHEN e % 37 = 0 OR e % 5 = 2 OR e % 5 = 0 THEN 1 ELSE 0 END AS probe
    FROM (SELECT *, event_id AS e, user_id % 16 AS session_id FROM events)"""


@query("B43 B44 B45", f"SELECT tick, bridge, queue, buffer, bag, tiles, gps, indoor, wifi, ble, path, probe FROM ({_LEVELS})")
def health_levels(t: Tables) -> DataFrame:
    report = telemetry.health_report(ticks(t))
    names = {
        "mapping/ros2_bridge": "bridge", "mapping/publish_queue": "queue", "mapping/local_sample_buffer": "buffer", "mapping/local_bag_storage": "bag", "mapping/geotiles": "tiles",
        "mapping/gps_quality": "gps", "mapping/indoor_localization": "indoor", "mapping/current_wifi": "wifi", "mapping/ble_beacons": "ble", "mapping/network_path": "path", "mapping/recorder_probe": "probe",
    }
    return report.groupBy("tick").agg(*[F.max(F.when(F.col("name") == n, F.col("level"))).alias(a) for n, a in names.items()])


@query("B54", f"""
    SELECT session_id, level, count(*) AS statuses FROM (SELECT session_id, unnest([bridge, queue, buffer, bag, 0, tiles, 0, gps, indoor, wifi, ble, path, probe]) AS level FROM ({_LEVELS}))
    WHERE level = 2 GROUP BY ALL""")
def worst_health(t: Tables) -> DataFrame:
    return telemetry.worst_level(telemetry.health_report(ticks(t)))


@query("B43 B44 B45", """
    SELECT name, message, count(*) AS ticks FROM (
        SELECT 'mapping/publish_queue' AS name, CASE WHEN e % 19 = 0 THEN 'Publish queue has failed messages' WHEN e % 7 = 0 THEN 'Publish queue has dropped messages' WHEN e % 120 > 96 THEN 'Publish queue depth is high' ELSE 'Publish queue nominal' END AS message FROM (SELECT event_id AS e FROM events)
        UNION ALL SELECT 'mapping/network_path', CASE WHEN e % 37 = 0 THEN 'Network path diagnostics are not running' WHEN e % 3 = 2 AND e % 2 = 1 THEN CASE WHEN e % 5 = 0 THEN 'monitor failed' ELSE 'Waiting for Network.framework path update' END
            WHEN e % 3 = 0 THEN 'Network path satisfied via ' || CASE WHEN e % 2 = 0 THEN 'wifi' ELSE 'unknown interface' END WHEN e % 3 = 1 THEN 'Network path requires a connection'
            WHEN e % 4 = 0 THEN 'Network path is unsatisfied: no route' ELSE 'Network path is unsatisfied' END FROM (SELECT event_id AS e FROM events)
        UNION ALL SELECT 'mapping/recorder_probe', CASE WHEN e % 37 = 0 THEN 'Recorder endpoint probes are not running' WHEN e % 5 = 2 THEN 'Waiting for recorder endpoint probe' WHEN e % 5 = 0 THEN 'Recorder endpoint probe failed: timeout'
            ELSE 'Recorder RTT ' || (e % 300) || '.0 ms, upload ' || (e % 50) || '.0 KB/s' END FROM (SELECT event_id AS e FROM events)) GROUP BY ALL""")
def health_messages(t: Tables) -> DataFrame:
    report = telemetry.health_report(ticks(t)).filter("name in ('mapping/publish_queue', 'mapping/network_path', 'mapping/recorder_probe')")
    return report.groupBy("name", "message").agg(F.count("*").alias("ticks"))


@query("B46", """
    SELECT key, count(*) AS entries, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS total FROM (
        SELECT unnest(['capacity', 'depth', 'dropped_messages', 'failed_messages', 'in_flight', 'sent_messages', 'retried_messages']) AS key,
               unnest([120, event_id % 120, (event_id % 7 = 0)::BIGINT, (event_id % 19 = 0)::BIGINT, event_id % 4, event_id % 1000, event_id % 6]) AS value FROM events) GROUP BY key""")
def status_entries(t: Tables) -> DataFrame:
    flat = telemetry.flatten_status(telemetry.health_report(ticks(t)).filter("name = 'mapping/publish_queue'")).filter("key <> 'last_error'")
    return flat.groupBy("key").agg(F.count("*").alias("entries"), F.sum(F.col("value").cast("bigint")).alias("total"))


_SHOWN = """
    SELECT e AS tick, 'mapping/ros2_bridge' AS name, ['connected', 'enabled_streams', 'recorder_url'] AS keys, [(e % 5 <> 0)::VARCHAR, CASE WHEN e % 2 = 0 THEN 'gps,pose' ELSE 'pose' END, 'ws://h' || (e % 3)] AS vals FROM E
    UNION ALL SELECT e, 'mapping/publish_queue', ['last_error'], [CASE WHEN e % 19 = 0 THEN 'socket closed' ELSE '' END] FROM E
    UNION ALL SELECT e, 'mapping/local_sample_buffer',
        ['dropped_samples', 'last_buffered_at', 'max_mesh_samples', 'max_point_cloud_samples', 'max_total_bytes', 'mesh_samples', 'point_cloud_samples', 'replayed_samples', 'total_bytes'],
        [(e % 17 = 0)::BIGINT::VARCHAR, CASE WHEN e % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '' END, '5', '30', '20000000', (e % 5)::VARCHAR, (e % 30)::VARCHAR, (e % 2)::VARCHAR, (e % 100 * 200000)::VARCHAR] FROM E
    UNION ALL SELECT e, 'mapping/geotiles', ['last_published_at', 'publish_interval_seconds', 'running'], [CASE WHEN e % 3 = 0 THEN '2024-01-02T00:00:00Z' ELSE '' END, '60', (e % 21 <> 0)::VARCHAR] FROM E
    UNION ALL SELECT e, 'mapping/stream_payload_metrics', list_transform(k, lambda x: s || '_' || x),
        ['2.5000', (e % 50 * 40)::VARCHAR, 'zlib', (e % 39)::VARCHAR, '', (e % 40)::VARCHAR, (e % 50)::VARCHAR, (e % 50 * 100)::VARCHAR]
    FROM E, (VALUES ('camera', 0), ('lidar', 1)) m(s, nth), (SELECT ['compression_ratio', 'encoded_bytes_total', 'last_compression', 'last_encoded_bytes', 'last_recorded_at', 'max_encoded_bytes', 'message_count', 'original_bytes_total'] AS k) WHERE e % 3 > nth"""


@query("B54 B46", f"WITH E AS (SELECT event_id AS e FROM events) SELECT tick, name, unnest(keys) AS key, unnest(vals) AS value FROM ({_SHOWN})")
def status_values_shown(t: Tables) -> DataFrame:
    """Every value of five statuses: bridge, queue error, buffer, tiles, and the metrics of each stream."""
    names = ("ros2_bridge", "publish_queue", "local_sample_buffer", "geotiles", "stream_payload_metrics")
    flat = telemetry.flatten_status(telemetry.health_report(ticks(t)).filter(F.col("name").isin(*[f"mapping/{n}" for n in names])))
    return flat.filter("name <> 'mapping/publish_queue' OR key = 'last_error'").select("tick", "name", "key", "value")


@query("B47 A13", """
    SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'disabled' WHEN p_partkey % 3 = 0 THEN 'missing_credentials' WHEN p_partkey % 5 = 0 THEN 'recording_not_allowed' ELSE 'configured' END AS status FROM part""")
def provider_states(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    return t.table("part").select(p.alias("seq"), health.provider_status(p % 2 != 0, p % 3 != 0, p % 5 != 0).alias("status"))


# --- radio ---------------------------------------------------------------------------------------------------------------


@query("B36", sql("""
    SELECT seq, CASE WHEN s >= 0.75e0 THEN 'high' WHEN s >= 0.45e0 THEN 'medium' WHEN s >= 0.2e0 THEN 'low' ELSE 'poor' END AS wifi, CASE kind WHEN 'view' THEN 10 WHEN 'click' THEN 5 ELSE 0 END AS path
    FROM (SELECT seq, kind, (seq % 101) / 100e0 AS s FROM S_radio)""", "S_radio"))
def signal_labels(t: Tables) -> DataFrame:
    status = F.when(F.col("kind") == "view", "satisfied").when(F.col("kind") == "click", "requires_connection").otherwise("unsatisfied")
    return t.radio().select("seq", radio.wifi_label((F.col("seq") % 101) / F.lit(100.0)).alias("wifi"), (radio.path_quality(status) * 10).cast("int").alias("path"))


def _radio_table(t: Tables) -> DataFrame:
    """Events as the four kinds of radio sample, in the one radio schema."""
    e, n = F.col("seq"), F.col("seq").cast("string")
    base = t.radio()
    texts = F.array().cast("array<string>")
    wifi = base.filter("kind = 'view'").select(
        "session_id", "stamp_ns", F.concat(F.lit("net"), (e % 3).cast("string")).alias("ssid"), F.when(e % 2 == 0, F.concat(F.lit("b"), n)).otherwise("").alias("bssid"),
        F.when(e % 5 == 0, F.lit(float("nan"))).otherwise((e % 101) / F.lit(100.0)).alias("signal_strength"), (e % 2 == 0).alias("is_secure"), F.lit(True).alias("did_auto_join"), F.lit(False).alias("did_just_join"),
    )
    ble = base.filter("kind = 'click'").select(
        "session_id", "stamp_ns", F.concat(F.lit("p"), F.col("source").cast("string")).alias("peripheral_id"), F.lit("Beacon").alias("local_name"), F.array(F.lit("180F")).alias("service_uuids"),
        (e % 2 == 0).alias("is_connectable"), F.col("rssi").alias("rssi_dbm"), F.create_map(F.lit("k"), n).alias("advertisement_data"),
    )
    path = base.filter("kind = 'error'").select(
        "session_id", "stamp_ns", F.when(e % 2 == 0, F.array(F.lit("wifi"), F.lit("cellular"))).otherwise(F.array(F.lit("wifi"))).alias("interface_types"), F.lit("satisfied").alias("status"), (e % 3 == 0).alias("is_expensive"),
        F.lit(False).alias("is_constrained"), texts.alias("available_interfaces"), F.lit(True).alias("supports_dns"), F.lit(True).alias("supports_ipv4"), F.lit(False).alias("supports_ipv6"), F.lit("").alias("unsatisfied_reason"),
    )
    probe = base.filter("kind = 'purchase'").select(
        "session_id", "stamp_ns", F.lit("ws://host:9090").alias("recorder_url"), F.lit(5.0).alias("rtt_ms"), (e * 1.0).alias("rate"), (e % 4 != 0).alias("success"), F.lit("").alias("error"),
        F.lit(1.0).alias("throughput_elapsed_ms"), F.lit(4).alias("throughput_message_count"), F.lit(65536).alias("throughput_payload_bytes"),
    )
    return radio.radio_rows(wifi, ble, path, probe)


@query("B37 G5", sql(f"""
    SELECT radio_type, source_id, count(*) AS samples, CAST(sum(q) AS BIGINT) AS quality FROM (
        SELECT CASE kind WHEN 'view' THEN 'wifi' WHEN 'click' THEN 'ble' WHEN 'error' THEN 'network_path' ELSE 'recorder_probe' END AS radio_type,
               CASE kind WHEN 'view' THEN CASE WHEN seq % 2 = 0 THEN 'b' || seq ELSE 'net' || (seq % 3) END WHEN 'click' THEN 'p' || source WHEN 'error' THEN CASE WHEN seq % 2 = 0 THEN 'wifi,cellular' ELSE 'wifi' END ELSE 'ws://host:9090' END AS source_id,
               CASE kind WHEN 'view' THEN CASE WHEN seq % 5 = 0 THEN 0 ELSE seq % 101 END WHEN 'click' THEN 0 WHEN 'error' THEN 100 ELSE CASE WHEN seq % 4 <> 0 THEN 100 ELSE 0 END END AS q
        FROM S_radio WHERE kind IN ('view', 'click', 'error', 'purchase')) GROUP BY ALL""", "S_radio"))
def radio_observations(t: Tables) -> DataFrame:
    rows = _radio_table(t)
    return rows.groupBy("radio_type", "source_id").agg(F.count("*").alias("samples"), F.sum(whole(F.col("quality") * 100)).alias("quality"))


@query("B38", sql("""
    SELECT seq, 'ble_advertisement:' || kind || ':' || source || ':' || (stamp_ns // 1000000000) || '.' || lpad(CAST(stamp_ns % 1000000000 // 1000 AS VARCHAR), 6, '0') AS dedup_key FROM S_radio""", "S_radio"))
def radio_keys(t: Tables) -> DataFrame:
    key = radio.dedup_key(F.lit("ble_advertisement"), F.col("kind"), F.col("source").cast("string"), F.col("stamp_ns") / F.lit(1e9))
    return t.radio().select("seq", key.alias("dedup_key"))


@query("B39", sql("""
    SELECT seq FROM S_radio WHERE source IN (3, 5) OR seq % 4 = 0 OR lower(kind) LIKE 'vie%'""", "S_radio"))
def beacon_targets(t: Tables) -> DataFrame:
    uuids = F.when(F.col("seq") % 4 == 0, F.array(F.lit("180F"), F.lit("FEAA"))).otherwise(F.array(F.lit("180A")))
    target = radio.ble_target(F.col("source").cast("string"), uuids, F.upper("kind"), ["3", "5"], ["FEAA"], ["Vie"])
    return t.radio().filter(target).select("seq")


@query("B41", """
    SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'a,b,c,x,y' ELSE 'a,b,x,y' END AS uuids, CAST(length('m' || event_id) AS BIGINT) AS manufacturer_bytes, CAST(3 AS BIGINT) AS data_bytes FROM events""")
def beacon_adverts(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.table("events").select(
        e.alias("seq"), F.array(F.lit("a"), F.lit("b")).alias("service_uuids"), F.array(F.lit("b"), F.when(e % 3 == 0, F.lit("c")).otherwise(F.lit("a"))).alias("overflow_uuids"),
        F.lit(None).cast("array<string>").alias("solicited_uuids"), F.create_map(F.lit("y"), F.lit(b"12"), F.lit("x"), F.lit(b"123")).alias("service_data"),
        F.concat(F.lit("m"), e.cast("string")).cast("binary").alias("manufacturer_data"), F.lit(4).alias("tx_power"), F.lit(True).alias("connectable"),
    )
    out = radio.ble_advert(rows)
    return out.select("seq", F.array_join("advertised_uuids", ",").alias("uuids"), F.col("manufacturer_data_bytes").cast("bigint").alias("manufacturer_bytes"), F.col("service_data_bytes")[0]["bytes"].cast("bigint").alias("data_bytes"))


_TOL = 6 * 3600 * 10**9
_POSITIONED = f"""
    SELECT r.session_id, r.seq, r.rssi, r.stamp_ns - p.stamp_ns <= {_TOL} AS local_ok, CASE WHEN r.stamp_ns - p.stamp_ns <= {_TOL} THEN p.x END AS x, CASE WHEN r.stamp_ns - p.stamp_ns <= {_TOL} THEN p.y END AS y,
           coalesce(r.stamp_ns - f.stamp_ns <= {_TOL}, false) AS world_ok
    FROM S_radio r ASOF LEFT JOIN (SELECT session_id, stamp_ns, rssi * -0.1e0 AS x, (seq % 50) / 10e0 AS y FROM S_radio WHERE kind = 'view') p ON r.session_id = p.session_id AND r.stamp_ns >= p.stamp_ns
    ASOF LEFT JOIN (SELECT session_id, stamp_ns FROM S_radio WHERE kind = 'click') f ON r.session_id = f.session_id AND r.stamp_ns >= f.stamp_ns"""


def _positioned(t: Tables) -> DataFrame:
    rows = t.radio()
    pose = rows.filter("kind = 'view'").select("session_id", "seq", "stamp_ns", (F.col("rssi") * F.lit(-0.1)).alias("x"), ((F.col("seq") % 50) / F.lit(10.0)).alias("y"), F.lit(0.0).alias("z"))
    fix = rows.filter("kind = 'click'").select("session_id", "seq", "stamp_ns", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("alt"))
    return joins.radio_position(rows, pose, fix, _TOL)


@query("C13", sql(f"""
    SELECT session_id, seq, coalesce(local_ok, false) AS local_ok, world_ok, {_q('coalesce(x, 0e0)')} AS x, {_q('coalesce(y, 0e0)')} AS y, CAST(0 AS BIGINT) AS z,
           CASE WHEN world_ok THEN 10000 ELSE 0 END AS lat, CASE WHEN world_ok THEN 20000 ELSE 0 END AS lon, CASE WHEN world_ok THEN 30000 ELSE 0 END AS alt FROM ({_POSITIONED})""", "S_radio"))
def positioned_radio(t: Tables) -> DataFrame:
    out = _positioned(t)
    return out.select("session_id", "seq", F.col("map_position_available").alias("local_ok"), F.col("geodetic_position_available").alias("world_ok"), *[quantize(F.col(c)).alias(c) for c in ("x", "y", "z", "lat", "lon", "alt")])


@query("D15", sql(f"""
    SELECT session_id, CAST(floor(x / 0.5e0) AS BIGINT) AS cx, CAST(floor(y / 0.5e0) AS BIGINT) AS cy, CAST(0 AS BIGINT) AS cz, count(*) AS samples, {_q('max(rssi)')} AS max_rssi, {_q('min(rssi)')} AS min_rssi,
           CAST(floor(avg(rssi) * 1e4 + 0.371931e0) AS BIGINT) AS mean_rssi FROM ({_POSITIONED}) WHERE local_ok GROUP BY ALL""", "S_radio"))
def signal_map(t: Tables) -> DataFrame:
    rows = _positioned(t).withColumnRenamed("rssi", "rssi_dbm")
    out = telemetry.signal_grid(rows, 0.5)
    return out.select("session_id", "cx", "cy", "cz", "samples", quantize(F.col("max_rssi")).alias("max_rssi"), quantize(F.col("min_rssi")).alias("min_rssi"), F.floor(F.col("mean_rssi") * F.lit(1e4) + F.lit(0.371931)).alias("mean_rssi"))


@query("B49", sql("SELECT row_id, greatest(0, recv_ns - stamp_ns - 500000) AS duration_ns FROM S_msg", "S_msg"))
def message_delays(t: Tables) -> DataFrame:
    return t.msg().select("row_id", stamps.duration_ns(F.col("stamp_ns") + 500_000, F.col("recv_ns")).alias("duration_ns"))


@query("D14 B49", sql("""
    SELECT session_id, CASE WHEN count(DISTINCT topic) <= 2 THEN string_agg(DISTINCT topic, ', ' ORDER BY topic) ELSE min(topic) || ', ' || (list_sort(list(DISTINCT topic)))[2] || ' +' || (count(DISTINCT topic) - 2) END AS topics
    FROM S_msg GROUP BY session_id""", "S_msg"))
def session_topic_summaries(t: Tables) -> DataFrame:
    return log.session_preview(t.msg().withColumn("data", F.lit("")), []).select("session_id", topic_summary(F.col("topics")).alias("topics"))
