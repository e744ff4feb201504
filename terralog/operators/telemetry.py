"""Telemetry: payload metrics, publisher counters, sessions, health reports, radio grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog.dimensions import (
    OPTIONAL_PROVIDER_DDL,
    OPTIONAL_PROVIDERS,
    PLATFORM_RESTRICTION_DDL,
    PLATFORM_RESTRICTIONS,
    RADIO_CHANNEL_DDL,
    RADIO_CHANNELS,
    TOPICS,
    advertised_topics,
    listed,
)
from terralog.functions import health
from terralog.functions.localization import global_quality, indoor_quality, quality_label, source_score
from terralog.functions.numeric import fixed
from terralog.operators.ordered import BUCKET_NS, OrderedRows, join_same, quantile_of, ranked_values

GRAVITY = 9.81
THERMAL_INTERVALS = {"nominal": 0.1, "fair": 0.1, "serious": 0.25, "critical": 0.5}
INITIAL_INTERVAL = 0.2


# --- sizes and counters ------------------------------------------------------------------------------------------------


def payload_sizes(df: DataFrame) -> DataFrame:
    """Original and encoded bytes by kind of message (cloud, calibration, markers, snapshot)."""
    kind = F.col("kind")
    original = (
        F.when(kind == "cloud", F.col("points") * 16)
        .when(kind == "calibration", F.lit(8))
        .when(kind == "markers", F.col("points") * 12)
        .otherwise(F.col("original_bytes"))
    )
    encoded = (
        F.when(kind == "cloud", F.octet_length("data"))
        .when(kind.isin("calibration", "markers"), F.col("envelope_bytes"))
        .otherwise(F.col("published_bytes"))
    )
    return df.withColumns({"original_bytes": original.cast("bigint"), "encoded_bytes": encoded.cast("bigint")})


def payload_metric_columns(order: Column) -> list[Column]:
    """The running metrics of one stream; negative sizes count as 0."""
    original = F.greatest(F.lit(0), F.col("original_bytes"))
    encoded = F.greatest(F.lit(0), F.col("encoded_bytes"))
    ratio = F.when(F.sum(original) > 0, F.sum(encoded) / F.sum(original)).otherwise(F.lit(0.0))
    return [
        F.count("*").alias("message_count"),
        F.sum(original).alias("original_bytes_total"),
        F.sum(encoded).alias("encoded_bytes_total"),
        F.max(encoded).alias("max_encoded_bytes"),
        F.max_by(original, order).alias("last_original_bytes"),
        F.max_by(encoded, order).alias("last_encoded_bytes"),
        F.max_by("compression", order).alias("last_compression"),
        F.max_by("ts_ns", order).alias("last_recorded_ns"),
        ratio.alias("compression_ratio"),
    ]


def payload_metrics(df: DataFrame, key: Sequence[str] = ("stream",)) -> DataFrame:
    return df.groupBy(*key).agg(*payload_metric_columns(F.col("seq")))


def publisher_stats(events: DataFrame) -> DataFrame:
    """Counters per session; the last error is cleared by a later success."""
    order = F.struct("seq")
    kind = F.col("kind")
    last = F.max_by(
        F.when(kind == "sent", F.lit("")).otherwise(F.coalesce("error", F.lit(""))),
        F.when((kind == "sent") | F.col("error").isNotNull(), order),
    )
    counts = [F.count_if(kind == name).alias(f"{name}_messages") for name in ("sent", "dropped", "retried", "failed")]
    out = events.groupBy("session_id").agg(*counts, F.coalesce(last, F.lit("")).alias("last_error"))
    return out.withColumn("message_count", F.col("sent_messages") + F.col("failed_messages"))


def probe_rate(bytes_: Column, count: Column, elapsed_ms: Column) -> Column:
    """Bytes per second over at least one millisecond."""
    return bytes_ * count / (F.greatest(elapsed_ms, F.lit(1.0)) / F.lit(1000.0))


def probe_throughput(df: DataFrame) -> DataFrame:
    """Per probe: rate and round trip; a failure has round trip -1 and rate 0."""
    ok = F.col("success")
    return df.withColumns(
        {
            "rate": F.when(ok, probe_rate(F.col("payload_bytes"), F.col("message_count"), F.col("elapsed_ms"))).otherwise(F.lit(0.0)),
            "rtt_ms": F.when(ok, F.col("rtt_ms")).otherwise(F.lit(-1.0)),
        }
    )


def probe_summary(df: DataFrame) -> DataFrame:
    """Per session: probes, failures, mean rate and exact round-trip quantiles (half, 95 %) of the successful ones."""
    ok = F.col("success")
    rates = probe_throughput(df)
    sums = rates.groupBy("session_id").agg(
        F.count("*").alias("probes"),
        F.count_if(~ok).alias("failures"),
        F.avg(F.when(ok, F.col("rate"))).alias("mean_rate"),
    )
    trips = ranked_values(rates.filter(ok).select("session_id", "rtt_ms"), ["session_id"], "rtt_ms")
    quantiles = trips.groupBy("session_id").agg(F.array(quantile_of("rtt_ms", "0.5"), quantile_of("rtt_ms", "0.95")).alias("rtt_ms"))
    return join_same(sums, quantiles, ["session_id"])


def bytes_by_kind(files: DataFrame) -> DataFrame:
    """Per session: bytes and number of log chunks, and of all files."""
    chunk = F.col("kind") == "chunk"
    return files.groupBy("session_id").agg(
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum(F.when(chunk, F.col("bytes"))), F.lit(0)).alias("chunk_bytes"),
        F.count_if(chunk).alias("chunks"),
        F.count("*").alias("files"),
    )


def buffer_stats(events: DataFrame) -> DataFrame:
    """Per session: what was buffered by kind, bytes, dropped, replayed, when last."""
    action = F.col("action")
    return events.groupBy("session_id").agg(
        F.count_if((action == "buffered") & (F.col("kind") == "cloud")).alias("cloud_samples"),
        F.count_if((action == "buffered") & (F.col("kind") == "mesh")).alias("mesh_samples"),
        F.coalesce(F.sum(F.when(action == "buffered", F.col("bytes"))), F.lit(0)).alias("buffered_bytes"),
        F.count_if(action == "dropped").alias("dropped_samples"),
        F.count_if(action == "replayed").alias("replayed_samples"),
        F.max(F.when(action == "buffered", F.col("ts_ns"))).alias("last_buffered_ns"),
    )


# --- latest, recent, stale ---------------------------------------------------------------------------------------------


def latest_per(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, as an aggregation (partial on the map side, no sort)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def keep_recent(df: DataFrame, group: Sequence[str], source: str, order: Sequence[str], n: int | None = None) -> DataFrame:
    """The newest row of each of the n most recent sources per group (None: of all)."""
    newest = latest_per(df, [*group, source], order)
    if n is None:
        return newest
    ranked = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order], source))
    return newest.withColumn("_rank", ranked).filter(F.col("_rank") <= n).drop("_rank")


def staleness(df: DataFrame, key: Sequence[str], stamp: str, tie: str, seconds: float = health.STALE_SECONDS, width: int | None = BUCKET_NS, block: str | None = None) -> DataFrame:
    """Gap to the row before (null on the first) and whether it is longer than ``seconds``."""
    rows = OrderedRows(df, key, [stamp, tie], width=width, block=block).previous("_before", stamp).result()
    gap = (F.col(stamp) - F.col(f"_before.{stamp}")) / F.lit(1e9)
    return rows.withColumn("gap_s", gap).withColumn("stale", F.coalesce(gap > seconds, F.lit(False))).drop("_before")


def thermal_interval(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str = "state", width: int | None = BUCKET_NS) -> DataFrame:
    """Processing interval in force: from the state, unknown states keep the one before, 0.2 s at the start.  ``width`` is
    in units of the first order column."""
    known = F.lit(None).cast("double")
    for name, value in THERMAL_INTERVALS.items():
        known = F.when(F.col(state) == name, F.lit(value)).otherwise(known)
    rows = OrderedRows(df.withColumn("_known", known), key, order, width=width).carry("interval_s", F.col("_known")).result()
    return rows.withColumn("interval_s", F.coalesce("interval_s", F.lit(INITIAL_INTERVAL))).drop("_known")


def imu_rows(df: DataFrame) -> DataFrame:
    """Acceleration in m/s2: (user + gravity) * 9.81 per axis."""
    return df.withColumns({f"a{c}": (F.col(f"user_{c}") + F.col(f"gravity_{c}")) * F.lit(GRAVITY) for c in "xyz"})


# --- sessions ----------------------------------------------------------------------------------------------------------


def session_state(events: DataFrame) -> DataFrame:
    """Current state per session from its lifecycle events.

    The start is the first ``started`` after which the session was not ended; an end counts only while no later start
    came.  Errors are those of the newest event.
    """
    order = F.col("seq")
    started, stopped = F.col("event") == "started", F.col("event") == "stopped"
    out = events.groupBy("session_id").agg(
        F.max_by("state", order).alias("state"),
        F.max_by("event", order).alias("last_event"),
        F.min(F.when(started, F.col("ts_ns"))).alias("started_ns"),
        F.max_by("enabled_streams", order).alias("enabled_streams"),
        F.max(F.when(started, order)).alias("_s"),
        F.max(F.when(stopped, F.struct(order, F.col("ts_ns")))).alias("_e"),
        F.coalesce(F.max_by("last_error", order), F.lit("")).alias("last_error"),
        F.count("*").alias("events"),
    )
    ended = F.when(F.col("_s").isNull() | (F.col("_e.seq") > F.col("_s")), F.col("_e.ts_ns"))
    return out.withColumn("ended_ns", ended).drop("_s", "_e")


def session_document(events: DataFrame, metrics: DataFrame, stats: DataFrame, topics: Sequence[tuple] = TOPICS) -> DataFrame:
    """One row per lifecycle event with its scalars and the JSON-text sections.

    Topics, radio channels, their restrictions and provider slots are constants; metrics are one row per session and stream, counters one row per session.
    """
    with_topics = events.withColumn("advertised_topics", advertised_topics(F.col("enabled_streams"), topics))
    metric_cols = [c for c in metrics.columns if c not in ("session_id", "stream")]
    metric_json = metrics.groupBy("session_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("stream", *metric_cols)))).alias("stream_payload_metrics")
    )
    stat_json = stats.select(
        "session_id", F.to_json(F.struct(*[c for c in stats.columns if c != "session_id"])).alias("publish_queue")
    )
    out = with_topics.join(metric_json, "session_id", "left").join(stat_json, "session_id", "left")
    return out.withColumns(
        {
            "stream_payload_metrics": F.coalesce("stream_payload_metrics", F.lit("[]")),
            "publish_queue": F.coalesce("publish_queue", F.lit("{}")),
            "enabled_streams": F.array_sort("enabled_streams"),
            "radio_channels": listed(RADIO_CHANNELS, RADIO_CHANNEL_DDL),
            "radio_platform_restrictions": listed(PLATFORM_RESTRICTIONS, PLATFORM_RESTRICTION_DDL),
            "optional_geo_provider_configurations": listed(OPTIONAL_PROVIDERS, OPTIONAL_PROVIDER_DDL),
        }
    )


# --- health ------------------------------------------------------------------------------------------------------------

STATUS_NAMES = (
    "mapping/ros2_bridge", "mapping/publish_queue", "mapping/local_sample_buffer", "mapping/local_bag_storage",
    "mapping/stream_payload_metrics", "mapping/geotiles", "mapping/geotile_optional_providers", "mapping/gps_quality",
    "mapping/indoor_localization", "mapping/current_wifi", "mapping/ble_beacons", "mapping/network_path", "mapping/recorder_probe",
)


def status_row(name: str, outcome: Column, values: dict[str, Column] | Column) -> Column:
    """One named status; where the keys are known here, their order is fixed without sorting at run time."""
    if isinstance(values, Column):
        return F.struct(F.lit(name).alias("name"), outcome.alias("outcome"), values.alias("values"))
    pairs = [F.struct(F.lit(k).alias("key"), F.coalesce(values[k].cast("string"), F.lit("")).alias("value")) for k in sorted(values)]
    entries = F.array(*pairs) if pairs else F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(F.lit(name).alias("name"), outcome.alias("outcome"), entries.alias("values"))


#: Values that each stream adds to the payload status, under its own name.
METRIC_VALUES = (
    "message_count", "original_bytes_total", "encoded_bytes_total", "max_encoded_bytes", "last_encoded_bytes", "last_compression", "compression_ratio", "last_recorded_at",
)


def metric_entries(metrics: Column) -> Column:
    """{key, value} per stream and value of an array of metrics (``stream`` and ``METRIC_VALUES``), sorted by key."""
    def shown(m: Column, name: str) -> Column:
        value = fixed(m[name], 4) if name == "compression_ratio" else m[name].cast("string")
        return F.struct(F.concat(m["stream"], F.lit(f"_{name}")).alias("key"), F.coalesce(value, F.lit("")).alias("value"))

    pairs = F.flatten(F.transform(metrics, lambda m: F.array(*[shown(m, n) for n in METRIC_VALUES])))
    return health.status_values(F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))))


def health_report(ticks: DataFrame) -> DataFrame:
    """Thirteen named statuses per tick (one input row per session and tick, columns as in ``plans.telemetry_queries.ticks``).

    A reading whose column ``ticks`` does not have is shown as an empty value.  ``metrics`` holds an entry per stream.
    """
    c = F.col

    def known(name: str) -> Column:
        return F.col(name) if name in ticks.columns else F.lit(None).cast("string")

    optional = F.struct(F.lit(0).alias("level"), F.lit("Optional geospatial provider configuration slots available").alias("message"))
    outcomes = (
        (health.bridge_health(c("connected")), {"connected": c("connected"), "recorder_url": known("recorder_url"), "enabled_streams": known("enabled_streams")}),
        (
            health.queue_health(c("failed"), c("dropped"), c("depth"), c("capacity")),
            {
                "capacity": c("capacity"), "depth": c("depth"), "in_flight": known("in_flight"), "sent_messages": known("sent"), "dropped_messages": c("dropped"),
                "retried_messages": known("retried"), "failed_messages": c("failed"), "last_error": known("queue_error"),
            },
        ),
        (
            health.buffer_health(c("buffer_dropped"), c("buffer_bytes"), c("buffer_max_bytes"), c("buffer_samples"), c("buffer_replayed")),
            {
                "point_cloud_samples": known("buffer_clouds"), "mesh_samples": known("buffer_meshes"), "total_bytes": c("buffer_bytes"), "max_total_bytes": c("buffer_max_bytes"),
                "max_point_cloud_samples": known("buffer_max_clouds"), "max_mesh_samples": known("buffer_max_meshes"), "dropped_samples": c("buffer_dropped"),
                "replayed_samples": c("buffer_replayed"), "last_buffered_at": known("buffered_at"),
            },
        ),
        (health.bag_health(c("bag_error"), c("recording"), c("bag_enabled")), {"recording": c("recording"), "enabled": c("bag_enabled")}),
        (health.metrics_health(c("metric_streams")), metric_entries(c("metrics")) if "metrics" in ticks.columns else {}),
        (
            health.tile_health(c("tile_error")),
            {"running": known("tiles_running"), "last_published_at": known("tiles_published_at"), "publish_interval_seconds": known("tile_interval_s")},
        ),
        (optional, {}),
        (
            health.gps_health(c("authorization"), c("running"), c("precise"), c("age_s"), c("hacc"), c("heading_available"), c("heading_acc"), c("heading_age_s")),
            {"running": c("running"), "location_authorization": c("authorization"), "horizontal_accuracy": c("hacc"), "last_heading_accuracy": c("heading_acc")},
        ),
        (
            health.indoor_health(c("indoor_error"), c("running"), c("precise"), c("age_s"), c("indoor_quality"), c("global_quality")),
            {"indoor_registration_quality": c("indoor_quality"), "global_registration_quality": c("global_quality")},
        ),
        (health.wifi_health(c("running"), c("entitled"), c("authorization"), c("wifi_label"), c("wifi_error")), {"running": c("running")}),
        (
            health.ble_health(c("running"), c("ble_authorization"), c("ble_central"), c("ble_filters"), c("ble_rssi"), c("ble_error")),
            {"central_state": c("ble_central"), "authorization": c("ble_authorization")},
        ),
        (health.path_health(c("running"), c("path_status"), c("path_interfaces"), c("path_reason"), c("path_error")), {"status": c("path_status")}),
        (
            health.probe_health(c("running"), c("probe_success"), c("probe_error"), c("probe_rtt_ms"), c("probe_rate"), c("probe_last_error")),
            {"success": c("probe_success")},
        ),
    )
    rows = F.array(*[status_row(name, outcome, values) for name, (outcome, values) in zip(STATUS_NAMES, outcomes)])
    return ticks.select("session_id", "tick", F.explode(rows).alias("_s")).select("session_id", "tick", "_s.name", "_s.outcome.*", "_s.values")


def worst_level(report: DataFrame) -> DataFrame:
    """Worst level per session, and how many statuses have it."""
    levels = report.groupBy("session_id", "level").agg(F.count("*").alias("_n"))
    return levels.groupBy("session_id").agg(F.max("level").alias("level"), F.max_by("_n", "level").alias("statuses"))


def flatten_status(report: DataFrame) -> DataFrame:
    """One row per key and value of each status."""
    return report.select("session_id", "tick", "name", F.explode("values").alias("_v")).select("session_id", "tick", "name", "_v.*")


def localization_scores(df: DataFrame) -> DataFrame:
    source = source_score(F.col("simulated"), F.col("accessory"))
    indoor = indoor_quality(F.col("hacc"), F.col("floor"), F.col("heading_acc"), F.col("age_s"), source)
    world = global_quality(F.col("lat"), F.col("lon"), F.col("hacc"), F.col("vacc"), F.col("heading_acc"), source)
    return df.withColumns({"indoor_quality": indoor, "global_quality": world}).withColumns(
        {"indoor_label": quality_label(F.col("indoor_quality")), "global_label": quality_label(F.col("global_quality"))}
    )


# --- radio -------------------------------------------------------------------------------------------------------------


def signal_grid(radio: DataFrame, cell: float) -> DataFrame:
    """Signal map: samples with a local position by floor cell; mean, max, min and number."""
    cells = {f"c{c}": F.floor(F.col(c) / F.lit(cell)).cast("bigint") for c in "xyz"}
    located = radio.filter("map_position_available").withColumns(cells)
    return located.groupBy("session_id", *cells).agg(
        F.avg("rssi_dbm").alias("mean_rssi"), F.max("rssi_dbm").alias("max_rssi"), F.min("rssi_dbm").alias("min_rssi"), F.count("*").alias("samples")
    )
