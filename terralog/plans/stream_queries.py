"""The operators as streams: the tables arrive as files, all that is there is processed, and the output is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.operators import telemetry
from terralog.functions.numeric import quantize, whole_div
from terralog.plans import geo_queries, log_queries, point_queries, telemetry_queries  # noqa: F401  (their oracles are used)
from terralog.plans.registry import all_queries, query, sql
from terralog.plans.views import Tables
from terralog.session import scratch_path
from terralog.sources.envelopes import stream_envelopes
from terralog.streaming import batches, stateful, stateless
from terralog.streaming.run import run_available


def _oracle(name: str) -> str:
    """The batch form of the same operator has the same result."""
    return all_queries()[name].oracle


class StreamTables(Tables):
    """The same views over the tables as streams of files: ranges of each table, in time order, each a batch of its own,
    so that state crosses batches."""

    FILES = 8

    def __init__(self, t: Tables, batches: int, arrival: dict[str, Column] | None = None):
        super().__init__(t.spark, t.folder)
        self.batches, self.arrival = batches, arrival or {}

    def table(self, name: str) -> DataFrame:
        stored = self.spark.read.parquet(self.path(name))
        # ids of the given tables grow with time; ``arrival`` says in which order rows come instead
        time = self.arrival.get(name, F.col(stored.columns[0])).cast("double")
        low, high = stored.agg(F.min(time), F.max(time)).first()
        part = F.least(F.floor((time - (low or 0)) / max(((high or 0) - (low or 0)) / self.batches, 1e-9)), F.lit(self.batches - 1))
        path = scratch_path(self.spark, f"arriving-{name}")
        for k in range(self.batches):  # one after the other, so that they arrive in order
            stored.filter(part == k).repartition(self.FILES).write.mode("append").parquet(path)
        return self.spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", self.FILES).parquet(path)


def _streams(t: Tables, batches: int = 3, arrival: dict[str, Column] | None = None) -> StreamTables:
    return StreamTables(t, batches, arrival)


def _in_batches(table: str, time: str, batches: int = 3) -> str:
    """SQL of the rows of a table with the number ``bat`` of the batch they come in, as ``StreamTables`` cuts them."""
    return f"""SELECT *, least(floor(({time} - (min({time}) OVER ())) / greatest(((max({time}) OVER ()) - (min({time}) OVER ())) / {batches}e0, 1e-9)), {batches - 1}) AS bat FROM {table}"""


@query("I1", _oracle("decoded_envelopes"))
def stream_decoded(t: Tables) -> DataFrame:
    rows = stateless.stream_decode(_streams(t).envelopes())
    return run_available(rows.select("session_id", "row_id", "topic", "stamp_ns"), "decode")


@query("I2", sql("SELECT DISTINCT kind || ':' || source || ':' || (stamp_ns // 86400000000000) AS dedup_key FROM S_radio", "S_radio"))
def stream_deduplicated(t: Tables) -> DataFrame:
    day = whole_div(F.col("stamp_ns"), 86_400_000_000_000).cast("string")
    rows = _streams(t).radio().withColumn("dedup_key", F.concat_ws(":", "kind", F.col("source").cast("string"), day))
    return run_available(stateless.stream_dedup(rows, "1 day").select("dedup_key"), "dedup")


@query("I4", _oracle("rate_gated"))
def stream_rate_gated(t: Tables) -> DataFrame:
    rows = _streams(t).msg().select("source", "stamp_ns", "row_id")
    kept = run_available(stateful.stream_rate_gate(rows, ["source"], 43_200_000_000_000), "gate")
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.sum(whole_div(F.col("stamp_ns"), 1_000_000_000)).alias("seconds"))


@query("I5", _oracle("thinned_points"))
def stream_thinned(t: Tables) -> DataFrame:
    first = stateful.stream_voxels(_streams(t).points(), 0.5, ["frame", "seq"])
    return run_available(first, "voxels").select("session_id", "vx", "vy", "vz", "frame", "seq")


@query("I6", _oracle("fused_surfels"))
def stream_fused(t: Tables) -> DataFrame:
    rows = _streams(t).points().withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0), "oz": F.lit(9.0)})
    cell = ["session_id", "vx", "vy", "vz"]
    fused = run_available(stateful.stream_surfels(rows, 1.0), "surfels", cell)
    red = F.when(F.col("observation_count") <= 65, F.col("r")).alias("r")
    return fused.select(*cell, "observation_count", "updated_at", quantize(F.col("confidence")).alias("confidence"), *[point_queries._near(F.col(c), 1e5).alias(c) for c in "xyz"], red)


@query("I7", _oracle("payload_metrics"))
def stream_payload_metrics(t: Tables) -> DataFrame:
    rows = _streams(t).payloads().withColumn("seq", F.struct("seq", "original_bytes"))
    out = run_available(telemetry.payload_metrics(rows), "metrics", ["stream"])
    return out.select("stream", "message_count", "original_bytes_total", "encoded_bytes_total", "max_encoded_bytes", "last_original_bytes", quantize(F.col("compression_ratio"), 1e9).alias("ratio"))


@query("I8", sql("""
    SELECT session_id, topic, stamp_ns // 3600000000000 * 3600000000000 AS start_ns, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes FROM S_msg
    WHERE stamp_ns // 3600000000000 * 3600000000000 + 3600000000000 <= (SELECT max(stamp_ns) // 1000000 * 1000000 FROM S_msg) - 300000000000 GROUP BY ALL""", "S_msg"))
def stream_topic_rates(t: Tables) -> DataFrame:
    """Final hours: those that the watermark (five minutes behind the newest message) has passed."""
    rates = stateless.stream_topic_rates(_streams(t).msg(), "1 hour")
    return run_available(rates.select("session_id", "topic", "start_ns", "messages", "bytes"), "rates")


@query("I9", sql("""
    SELECT session_id, stamp_ns AS last_ns FROM (SELECT session_id, stamp_ns, lead(stamp_ns) OVER (PARTITION BY session_id ORDER BY stamp_ns) AS next_ns FROM S_msg)
    WHERE next_ns - stamp_ns > 1800000000000 OR (next_ns IS NULL AND stamp_ns + 1800000000000 < (SELECT max(stamp_ns) FROM S_msg) - 2000000000)""", "S_msg"))
def stream_stale(t: Tables) -> DataFrame:
    return run_available(stateful.stream_staleness(_streams(t).msg().select("session_id", "stamp_ns"), 1800.0), "stale")


@query("I10", _oracle("session_states"))
def stream_session_states(t: Tables) -> DataFrame:
    rows = _streams(t).session_events().withColumn("last_error", F.coalesce("last_error", F.lit("")))
    return run_available(telemetry.session_state(rows), "sessions", ["session_id"]).drop("enabled_streams")


@query("I10", sql("""
    SELECT source, min(stamp_ns) AS start_ns, max(stamp_ns) + 21600000000000 AS end_ns, count(*) AS messages FROM (
        SELECT source, stamp_ns, sum(new) OVER (PARTITION BY source ORDER BY stamp_ns) AS g FROM (
            SELECT source, stamp_ns, CASE WHEN stamp_ns - lag(stamp_ns) OVER (PARTITION BY source ORDER BY stamp_ns) < 21600000000000 THEN 0 ELSE 1 END AS new FROM S_msg))
    GROUP BY source, g HAVING max(stamp_ns) + 21600000000000 <= (SELECT max(stamp_ns) // 1000000 * 1000000 FROM S_msg) - 300000000000""", "S_msg"))
def stream_gap_sessions(t: Tables) -> DataFrame:
    return run_available(stateless.stream_gap_sessions(_streams(t).msg(), "6 hours"), "gaps")


_PLACED_IN_TIME = f"""
    SELECT g.* FROM ({_oracle('georeferenced_fixes')}) g, (
        SELECT (greatest((SELECT max(c_custkey) FROM customer) * 1000000, (SELECT max(event_id) FROM events WHERE event_type = 'view') * 150000) // 1000 - 30000) * 1000 AS passed)
    WHERE g.seq * 1000000 < passed"""


@query("I11", _PLACED_IN_TIME)
def stream_georeferenced(t: Tables) -> DataFrame:
    """Fixes and poses that come up to 16 seconds late, over three batches, in the order of their stamps: all that the
    watermark (30 seconds behind the newest) has passed."""
    late = {"customer": F.col("c_custkey") + F.col("c_custkey") % 5 * 4, "events": F.col("event_id") + F.col("event_id") % 5 * 27}
    s = _streams(t, 3, late)
    placed = run_available(stateful.stream_origin(s.fixes(), s.poses(), watermark="30 seconds"), "origin")
    return placed.select("session_id", "seq", F.col("reason").isNull().alias("established"), "reason", *[quantize(F.col(f"map.{c}"), 10.0).alias(c) for c in "xyz"], *[quantize(F.col(f"enu.{c}"), 10.0).alias(c) for c in "enu"])


# --- written batch by batch ----------------------------------------------------------------------------------------------

_DAY = 86_400_000_000_000
_LATE = f"""
    SELECT *, coalesce(stamp_ns < max(newest) OVER (ORDER BY bat RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DAY}, false) AS late FROM (
        SELECT *, max(stamp_ns) OVER (PARTITION BY bat) AS newest FROM (
            SELECT user_id % 8 AS session_id, '/' || event_type AS topic, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS bytes, event_id AS row_id, bat,
                   epoch_us(ts) * 1000 - CASE WHEN event_id % 10 = 3 THEN {4 * _DAY} ELSE 0 END AS stamp_ns FROM ({_in_batches('events', 'event_id')})))"""


def _split(t: Tables) -> tuple[str, DataFrame]:
    """Messages of which a tenth carry a stamp of four days before, parted at a day behind the newest."""
    stamp = F.col("stamp_ns") - F.when(F.col("row_id") % 10 == 3, 4 * _DAY).otherwise(0)
    rows = _streams(t).msg().withColumn("stamp_ns", stamp).select("session_id", "topic", "bytes", "row_id", "stamp_ns")
    folder = scratch_path(t.spark, "arrivals")
    batches.run_writer(batches.split_late(rows, folder, _DAY), scratch_path(t.spark, "arrivals-state"))
    return folder, rows


@query("I2 I8 I9 I10", f"SELECT row_id, session_id, topic, stamp_ns FROM ({_LATE}) WHERE late")
def stream_late_rows(t: Tables) -> DataFrame:
    folder, rows = _split(t)
    return batches.late_rows(t.spark, folder, rows.schema).select("row_id", "session_id", "topic", "stamp_ns")


@query("I8", f"""
    WITH rows AS (SELECT * FROM ({_LATE}) WHERE NOT late)
    SELECT session_id, topic, stamp_ns // 3600000000000 * 3600000000000 AS start_ns, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes FROM rows
    WHERE stamp_ns // 3600000000000 * 3600000000000 + 3600000000000 <= (SELECT max(stamp_ns) // 1000000 * 1000000 FROM rows) - {_DAY} GROUP BY ALL""")
def stream_rates_in_time(t: Tables) -> DataFrame:
    """Final hours of the rows that were not late; their own watermark drops none of them."""
    folder, rows = _split(t)
    live = batches.on_time_rows(t.spark, folder, rows.schema)
    return run_available(stateless.stream_topic_rates(live, "1 hour", watermark="1 day").select("session_id", "topic", "start_ns", "messages", "bytes"), "rates")


_KINDS = {"fix": "sensor_msgs/msg/NavSatFix", "image": "sensor_msgs/msg/CompressedImage", "stats": "mapping_msgs/msg/PublisherStats"}
_LINES = """
    SELECT event_id AS e, event_id % 4 AS kind, event_id % 4 = 3 AS other, event_id % 17 = 0 AS broken, event_id % 13 = 0 AS subscribed, CASE event_id % 4 WHEN 0 THEN event_id % 10 = 4 WHEN 1 THEN event_id % 3 = 0 ELSE event_id % 5 = 0 END AS misfit FROM events"""


def _landed(t: Tables) -> str:
    """JSON lines of three known types and an unknown one, in files that arrive, to typed tables and rejects."""
    e = F.col("event_id")
    n, kind = e.cast("string"), e % 4
    name = F.when(kind == 0, "fix").when(kind == 1, "image").when(kind == 2, "stats").otherwise("other")
    type_ = F.when(kind == 0, _KINDS["fix"]).when(kind == 1, _KINDS["image"]).when(kind == 2, "legacy_msgs/PublisherStats").otherwise("std_msgs/String")
    fix = F.concat(F.lit('{"header":{"stamp":{"sec":'), n, F.lit('}},"latitude":'), F.when(e % 10 == 4, '"north"').otherwise("1.5"), F.lit("}"))
    image = F.concat(F.lit('{"format":"jpeg '), n, F.lit('","data":'), F.when(e % 3 == 0, '"***"').otherwise("[104,105]"), F.lit("}"))
    stats = F.concat(F.lit('{"sent_messages":"'), n, F.lit('","depth":'), F.when(e % 5 == 0, "-1").otherwise("3"), F.lit("}"))
    msg = F.when(kind == 0, fix).when(kind == 1, image).when(kind == 2, stats).otherwise("{}")
    line = F.concat(F.lit('{"op":"'), F.when(e % 13 == 0, "subscribe").otherwise("publish"), F.lit('","topic":"/legacy/'), name, F.lit('","type":"'), type_, F.lit('","msg":'), msg, F.lit("}"))
    stored = t.table("events").select("event_id", F.when(e % 17 == 0, F.concat(F.lit("broken "), n)).otherwise(line).alias("value"))
    arriving, folder = scratch_path(t.spark, "lines"), scratch_path(t.spark, "typed")
    for k in range(3):
        stored.filter(e % 3 == k).select("value").repartition(4).write.mode("append").text(arriving)
    lines = stream_envelopes(t.spark, arriving, "s", 4)
    batches.run_writer(batches.land_converted(lines, folder, list(_KINDS.values())), scratch_path(t.spark, "typed-state"))
    return folder


@query("A4 A5 I1 B8", f"SELECT CASE kind WHEN 0 THEN 'fix' WHEN 1 THEN 'image' ELSE 'stats' END AS kind, e AS number FROM ({_LINES}) WHERE NOT (other OR broken OR subscribed OR misfit)")
def stream_typed(t: Tables) -> DataFrame:
    """Rows of the typed tables that one stream of JSON lines fills, by a field of each type."""
    folder, m = _landed(t), F.col("message")
    number = {"fix": m["header"]["stamp"]["sec"], "image": F.substring_index(m["format"], " ", -1), "stats": m["sent_messages"]}
    rows = [
        batches.landed_types(t.spark, folder, _KINDS[kind], "session_id string, ").select(F.lit(kind).alias("kind"), n.cast("bigint").alias("number")) for kind, n in number.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("A4 A5 I1", f"""
    SELECT topic, reason, count(*) AS messages FROM (
        SELECT CASE WHEN broken THEN NULL WHEN kind = 0 THEN '/mapping/fix' WHEN kind = 1 THEN '/mapping/image' WHEN kind = 2 THEN '/mapping/stats' ELSE '/mapping/other' END AS topic,
               CASE WHEN broken THEN 'no schema for null' WHEN other THEN 'no schema for std_msgs/msg/String' WHEN subscribed THEN 'unsupported op subscribe'
                    WHEN misfit THEN 'fields do not fit ' || CASE kind WHEN 0 THEN '{_KINDS["fix"]}' WHEN 1 THEN '{_KINDS["image"]}' ELSE '{_KINDS["stats"]}' END END AS reason
        FROM ({_LINES})) WHERE reason IS NOT NULL GROUP BY ALL""")
def stream_rejects(t: Tables) -> DataFrame:
    rows = batches.landed_rejects(t.spark, _landed(t), "session_id string, ")
    return rows.groupBy("topic", "reason").agg(F.count("*").alias("messages"))


_CAP = 25
_STEPS = "".join(f""", seen{k} AS (SELECT session_id, vx, vy, vz, max(stamp_ns) AS updated FROM pts WHERE bat = {k} GROUP BY ALL),
    live{k} AS (
        SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated DESC, vx, vy, vz) AS place FROM (
            SELECT session_id, vx, vy, vz, coalesce(s.updated, l.updated) AS updated, coalesce(l.since, {k}) AS since FROM seen{k} s FULL JOIN {f'live{k - 1}' if k else '(SELECT *, 0 AS since FROM seen0 WHERE false)'} l USING (session_id, vx, vy, vz)))
        WHERE place <= {_CAP})""" for k in range(3))


@query("I6 F3", sql(f"""
    WITH pts AS (
        SELECT *, CAST(floor(x / 0.5e0) AS BIGINT) AS vx, CAST(floor(y / 0.5e0) AS BIGINT) AS vy, CAST(floor(z / 0.5e0) AS BIGINT) AS vz FROM ({_in_batches('S_point', 'frame')})){_STEPS},
    held AS (SELECT p.*, count(*) OVER c AS n, row_number() OVER (c ORDER BY stamp_ns, seq) AS i FROM pts p JOIN live2 l USING (session_id, vx, vy, vz) WHERE p.bat >= l.since WINDOW c AS (PARTITION BY session_id, vx, vy, vz))
    SELECT session_id, vx, vy, vz, count(*) AS observation_count, max(stamp_ns) AS updated_at, {', '.join(f"{point_queries._qn(f'sum(CASE WHEN n <= 65 THEN 1e0 / n ELSE pow(64e0 / 65e0, n - greatest(i, 65)) / 65e0 END * {c})', '1e5')} AS {c}" for c in 'xyz')}
    FROM held GROUP BY ALL""", "S_point"))
def stream_capped_surfels(t: Tables) -> DataFrame:
    """Live surfels, of which each session keeps the 25 newest after every batch; a cell that was dropped starts anew."""
    rows = _streams(t).points().withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0), "oz": F.lit(9.0)})
    folder = scratch_path(t.spark, "surfels")
    batches.run_writer(batches.keep_surfels(rows, folder, _CAP, 0.5), scratch_path(t.spark, "surfels-state"))
    live = batches.live_surfels(t.spark, folder, batches.surfel_schema(rows.schema, ["session_id"]), 0.5)
    return live.select("session_id", "vx", "vy", "vz", "observation_count", "updated_at", *[point_queries._near(F.col(c), 1e5).alias(c) for c in "xyz"])


@query("I2", sql("""
    SELECT session_id, dedup_key, arg_min(seq, seq) AS seq FROM (
        SELECT *, kind || ':' || (source % 20) AS dedup_key, count(*) FILTER (seq % 200 = 0) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM S_radio) WHERE seq % 200 <> 0
    GROUP BY session_id, run, dedup_key""", "S_radio"))
def stream_unpublished_radio(t: Tables) -> DataFrame:
    """Every two hundredth row resets its session; until then no key is published twice, however long ago it was."""
    s = _streams(t)
    named = F.concat_ws(":", "kind", (F.col("source") % 20).cast("string"))
    rows = s.radio().filter("seq % 200 <> 0").select("session_id", "seq", named.alias("dedup_key"))
    resets = s.radio().filter("seq % 200 = 0").select("session_id", "seq")
    return run_available(stateful.stream_unpublished(rows, resets, order=["seq"]), "published")
