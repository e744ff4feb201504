"""Radio samples: Wi-Fi, Bluetooth advertisements, network path and endpoint probe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.numeric import finite_or, fixed

SCHEMA_VERSION = 1

# Fixed field list of the radio message with its unset values, in message order.
RADIO_DEFAULTS: tuple[tuple[str, str, object], ...] = (
    ("session_id", "string", ""),
    ("schema_version", "bigint", SCHEMA_VERSION),
    ("channel_id", "string", ""),
    ("observation_kind", "string", ""),
    ("source_api", "string", ""),
    ("source_id", "string", ""),
    ("radio_type", "string", ""),
    ("tags", "array<string>", ()),
    ("map_position_available", "boolean", False),
    ("map_position", "struct<x:double,y:double,z:double>", None),
    ("geodetic_position_available", "boolean", False),
    ("latitude", "double", 0.0),
    ("longitude", "double", 0.0),
    ("altitude", "double", 0.0),
    ("ssid", "string", ""),
    ("bssid", "string", ""),
    ("signal_strength_normalized", "double", 0.0),
    ("is_secure", "boolean", False),
    ("peripheral_id", "string", ""),
    ("local_name", "string", ""),
    ("service_uuids", "array<string>", ()),
    ("is_connectable", "boolean", False),
    ("network_status", "string", ""),
    ("interface_types", "array<string>", ()),
    ("is_expensive", "boolean", False),
    ("is_constrained", "boolean", False),
    ("frequency_hz", "double", 0.0),
    ("rssi_dbm", "double", 0.0),
    ("snr_db", "double", 0.0),
    ("quality", "double", 0.0),
    ("round_trip_time_ms", "double", 0.0),
    ("throughput_bytes_per_second", "double", 0.0),
    ("success", "boolean", False),
    ("error", "string", ""),
    ("metadata_json", "string", "{}"),
)


def wifi_label(strength: Column) -> Column:
    return F.when(strength >= 0.75, "high").when(strength >= 0.45, "medium").when(strength >= 0.20, "low").otherwise("poor")


def path_quality(status: Column) -> Column:
    return F.when(status == "satisfied", F.lit(1.0)).when(status == "requires_connection", F.lit(0.5)).otherwise(F.lit(0.0))


def dedup_key(channel: Column, kind: Column, source: Column, seconds: Column) -> Column:
    return F.concat_ws(":", channel, kind, source, fixed(seconds))


def _default(kind: str, value: object) -> Column:
    if kind.startswith("struct"):
        return F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def _radio_select(df: DataFrame, channel: str, kind: str, api: str, radio: str, tags: Sequence[str], values: dict[str, Column]) -> DataFrame:
    fixed = {
        "channel_id": F.lit(channel), "observation_kind": F.lit(kind), "source_api": F.lit(api), "radio_type": F.lit(radio),
        "tags": F.array(*[F.lit(t) for t in tags]), "session_id": F.col("session_id").cast("string"),
    }
    given = fixed | values
    columns = []
    for name, type_, unset in RADIO_DEFAULTS:
        value = given[name].cast(type_) if name in given else _default(type_, unset)
        if type_ == "double":
            value = finite_or(value, 0.0)
        elif name in values:
            value = F.coalesce(value, _default(type_, unset))
        columns.append(value.alias(name))
    return df.select("stamp_ns", *columns)


def wifi_rows(df: DataFrame) -> DataFrame:
    c = F.col
    source = F.when(c("bssid") == "", c("ssid")).otherwise(c("bssid"))
    meta = F.to_json(
        F.struct(c("did_auto_join"), c("did_just_join"), wifi_label(c("signal_strength")).alias("signal_quality_label"))
    )
    return _radio_select(
        df, "current_wifi_network", "wifi_current_network", "NetworkExtension.NEHotspotNetwork.fetchCurrent", "wifi", ("wifi", "current_network"),
        {
            "source_id": source, "ssid": c("ssid"), "bssid": c("bssid"), "signal_strength_normalized": c("signal_strength"),
            "is_secure": c("is_secure"), "quality": c("signal_strength"), "success": F.lit(True), "metadata_json": meta,
        },
    )


def ble_rows(df: DataFrame) -> DataFrame:
    c = F.col
    return _radio_select(
        df, "ble_advertisement", "ble_advertisement", "CoreBluetooth.CBCentralManager", "ble", ("ble", "advertisement"),
        {
            "source_id": c("peripheral_id"), "peripheral_id": c("peripheral_id"), "local_name": c("local_name"),
            "service_uuids": c("service_uuids"), "is_connectable": c("is_connectable"), "rssi_dbm": c("rssi_dbm"),
            "success": F.lit(True), "metadata_json": F.to_json(F.struct(c("advertisement_data"))),
        },
    )


def path_rows(df: DataFrame) -> DataFrame:
    c = F.col
    meta = F.to_json(F.struct("available_interfaces", "supports_dns", "supports_ipv4", "supports_ipv6", "unsatisfied_reason"))
    return _radio_select(
        df, "network_path", "network_path_state", "Network.NWPathMonitor", "network_path", ("network_path",),
        {
            "source_id": F.concat_ws(",", c("interface_types")), "network_status": c("status"), "interface_types": c("interface_types"),
            "is_expensive": c("is_expensive"), "is_constrained": c("is_constrained"), "quality": path_quality(c("status")),
            "success": F.lit(True), "metadata_json": meta,
        },
    )


def probe_rows(df: DataFrame) -> DataFrame:
    c = F.col
    meta = F.to_json(F.struct("throughput_elapsed_ms", "throughput_message_count", "throughput_payload_bytes"))
    return _radio_select(
        df, "recorder_latency_probe", "recorder_endpoint_probe", "URLSessionWebSocketTask.sendPing and rosbridge publish", "recorder_probe",
        ("recorder", "latency", "throughput"),
        {
            "source_id": c("recorder_url"), "round_trip_time_ms": c("rtt_ms"), "throughput_bytes_per_second": c("rate"),
            "quality": F.when(c("success"), F.lit(1.0)).otherwise(F.lit(0.0)), "success": c("success"), "error": c("error"),
            "metadata_json": meta,
        },
    )


def radio_rows(wifi: DataFrame, ble: DataFrame, path: DataFrame, probe: DataFrame) -> DataFrame:
    """The four sample shapes in the one radio schema; what a source does not have is set to its unset value."""
    rows = wifi_rows(wifi)
    for other in (ble_rows(ble), path_rows(path), probe_rows(probe)):
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def ble_target(
    peripheral_id: Column, uuids: Column, name: Column, ids: Sequence[str], service_uuids: Sequence[str], prefixes: Sequence[str]
) -> Column:
    """Configured beacon: known id, a configured service, or a name prefix (any case); an empty name has no prefix."""
    known = peripheral_id.isin(*ids) if ids else F.lit(False)
    service = F.arrays_overlap(uuids, F.array(*[F.lit(u) for u in service_uuids])) if service_uuids else F.lit(False)
    lowered = F.lower(name)
    named = F.lit(False)
    for prefix in prefixes:
        named = named | F.startswith(lowered, F.lit(prefix.lower()))
    return F.coalesce(known, F.lit(False)) | F.coalesce(service, F.lit(False)) | F.coalesce((name != "") & named, F.lit(False))


def ble_advert(df: DataFrame) -> DataFrame:
    """All advertised service ids (first of equals), and the advertisement's sizes and flags."""
    lists = ("service_uuids", "overflow_uuids", "solicited_uuids")
    parts = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists]
    data_ids = F.coalesce(F.array_sort(F.map_keys("service_data")), F.array().cast("array<string>"))
    sizes = F.transform(
        data_ids, lambda u: F.struct(u.alias("uuid"), F.octet_length(F.element_at(F.col("service_data"), u)).alias("bytes"))
    )
    return df.withColumns(
        {
            "advertised_uuids": F.array_distinct(F.concat(*parts, data_ids)),
            "manufacturer_data_bytes": F.octet_length("manufacturer_data"),
            "service_data_bytes": sizes,
            "tx_power_level_dbm": F.col("tx_power").cast("int"),
            "is_connectable": F.col("connectable").cast("boolean"),
        }
    )


def publish_bytes(topic: Column, msg: Column) -> Column:
    """UTF-8 size of the published JSON envelope; null when the message is null."""
    return F.when(msg.isNotNull(), F.octet_length(F.to_json(F.struct(msg.alias("msg"), F.lit("publish").alias("op"), topic.alias("topic")))))
