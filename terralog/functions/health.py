"""Health levels (0 ok, 1 warning, 2 error) and messages; the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralog.functions.numeric import fixed

STALE_SECONDS = 10.0
POOR_ACCURACY_M = 25.0
POOR_HEADING_DEG = 45.0


def first_rule(rules: Sequence[tuple[Column, int, Column | str]], otherwise: tuple[int, Column | str]) -> Column:
    """{level, message} of the first rule whose condition is true; a null condition does not hold."""
    def outcome(level: int, message: Column | str) -> Column:
        text = message if isinstance(message, Column) else F.lit(message)
        return F.struct(F.lit(level).alias("level"), text.alias("message"))

    result = outcome(*otherwise)
    for condition, level, message in reversed(list(rules)):
        result = F.when(F.coalesce(condition, F.lit(False)), outcome(level, message)).otherwise(result)
    return result


def _not(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def bridge_health(connected: Column) -> Column:
    return first_rule([(_not(connected), 2, "Disconnected from ROS2 recorder")], (0, "Connected to ROS2 recorder"))


def queue_health(failed: Column, dropped: Column, depth: Column, capacity: Column) -> Column:
    return first_rule(
        [
            (failed > 0, 2, "Publish queue has failed messages"),
            (dropped > 0, 1, "Publish queue has dropped messages"),
            (depth > F.floor(capacity * F.lit(0.8)), 1, "Publish queue depth is high"),
        ],
        (0, "Publish queue nominal"),
    )


def buffer_health(dropped: Column, total_bytes: Column, max_bytes: Column, samples: Column, replayed: Column) -> Column:
    return first_rule(
        [
            (dropped > 0, 1, "Local sample buffer has dropped offline samples"),
            (total_bytes > F.floor(max_bytes * F.lit(0.8)), 1, "Local sample buffer is near capacity"),
            (samples > 0, 0, "Local sample buffer has pending offline samples"),
            (replayed > 0, 0, "Local sample buffer has replayed offline samples"),
        ],
        (0, "Local sample buffer empty"),
    )


def gps_health(
    authorization: Column, running: Column, precise: Column, age: Column, hacc: Column, heading_available: Column,
    heading_acc: Column, heading_age: Column,
) -> Column:
    return first_rule(
        [
            (authorization.isin("denied", "restricted"), 2, "Location permission is denied or restricted"),
            (_not(running), 1, "GPS quality monitor is not running"),
            (authorization == "not_determined", 1, "Location permission has not been granted yet"),
            (_not(precise), 1, "Precise location is not authorized"),
            (age.isNull() | (age > STALE_SECONDS), 1, "GPS fix is stale or unavailable"),
            (hacc < 0, 1, "GPS horizontal accuracy is unavailable"),
            (hacc > POOR_ACCURACY_M, 1, "GPS horizontal accuracy is poor"),
            (_not(heading_available), 1, "Heading updates are unavailable"),
            (heading_acc < 0, 1, "Heading accuracy is unavailable"),
            (heading_acc > POOR_HEADING_DEG, 1, "Heading confidence is poor"),
            (heading_age.isNull() | (heading_age > STALE_SECONDS), 1, "Heading fix is stale or unavailable"),
        ],
        (0, "GPS quality nominal"),
    )


def indoor_health(
    last_error: Column, running: Column, precise: Column, age: Column, indoor: Column, global_score: Column
) -> Column:
    return first_rule(
        [
            (last_error.isNotNull(), 1, last_error),
            (_not(running), 1, "Indoor localization is not running"),
            (_not(precise), 1, "Precise location is not authorized"),
            (age > STALE_SECONDS, 1, "Location fix is stale"),
            ((indoor < 0.25) | (global_score < 0.25), 1, "Indoor or global registration quality is low"),
        ],
        (0, "Indoor localization nominal"),
    )


def wifi_health(running: Column, entitled: Column, authorization: Column, label: Column, last_error: Column) -> Column:
    """``label`` is the quality of the last sample, null while there is none."""
    return first_rule(
        [
            (_not(running), 1, "Current Wi-Fi telemetry is not running"),
            (_not(entitled), 1, "Access WiFi Information entitlement is not configured"),
            (authorization.isin("denied", "restricted"), 1, "Location permission is required for current Wi-Fi signal quality"),
            (authorization == "not_determined", 1, "Waiting for location permission before reading current Wi-Fi signal quality"),
            (label.isNull(), 1, F.coalesce(last_error, F.lit("Current Wi-Fi network unavailable"))),
        ],
        (0, F.concat(F.lit("Current Wi-Fi signal quality available: "), label)),
    )


def ble_health(
    running: Column, authorization: Column, central: Column, has_filters: Column, last_rssi: Column, last_error: Column
) -> Column:
    return first_rule(
        [
            (_not(running), 1, "BLE beacon telemetry is not running"),
            (authorization.isin("denied", "restricted"), 2, "Bluetooth permission is required for BLE beacon RSSI"),
            (central == "unsupported", 2, "Bluetooth LE scanning is unsupported on this device"),
            (central == "unauthorized", 2, "Bluetooth authorization is unavailable for BLE beacon RSSI"),
            (_not(has_filters), 1, "Configure a BLE service UUID, peripheral UUID, or local-name prefix before scanning"),
            (central == "powered_off", 1, "Bluetooth is powered off"),
            (last_rssi.isNull(), 1, F.coalesce(last_error, F.lit("Waiting for configured BLE beacon advertisements"))),
        ],
        (0, F.format_string("BLE beacon RSSI available: %d dBm", last_rssi.cast("int"))),
    )


def path_health(running: Column, status: Column, interfaces: Column, reason: Column, last_error: Column) -> Column:
    """``status`` is null while no sample has come in; ``interfaces`` is the joined list."""
    reason = F.coalesce(reason, F.lit(""))
    unsatisfied = F.when(reason == "", F.lit("Network path is unsatisfied")).otherwise(
        F.concat(F.lit("Network path is unsatisfied: "), reason)
    )
    shown = F.when(F.coalesce(interfaces, F.lit("")) == "", F.lit("unknown interface")).otherwise(interfaces)
    return first_rule(
        [
            (_not(running), 1, "Network path diagnostics are not running"),
            (status.isNull(), 1, F.coalesce(last_error, F.lit("Waiting for Network.framework path update"))),
            (status == "satisfied", 0, F.concat(F.lit("Network path satisfied via "), shown)),
            (status == "requires_connection", 1, "Network path requires a connection"),
        ],
        (2, unsatisfied),
    )


def probe_health(running: Column, success: Column, error: Column, rtt_ms: Column, rate: Column, last_error: Column) -> Column:
    """``success`` is null while no sample has come in."""
    return first_rule(
        [
            (_not(running), 1, "Recorder endpoint probes are not running"),
            (success.isNull(), 1, F.coalesce(last_error, F.lit("Waiting for recorder endpoint probe"))),
            (_not(success), 1, F.concat(F.lit("Recorder endpoint probe failed: "), error)),
        ],
        (0, F.concat(F.lit("Recorder RTT "), fixed(rtt_ms, 1), F.lit(" ms, upload "), fixed(rate / F.lit(1024.0), 1), F.lit(" KB/s"))),
    )


def bag_health(last_error: Column, recording: Column, enabled: Column) -> Column:
    return first_rule(
        [
            (last_error.isNotNull(), 1, last_error),
            (recording, 0, "Local SQLite rosbag recording active"),
            (enabled, 0, "Local SQLite rosbag recording enabled"),
        ],
        (0, "Local SQLite rosbag recording disabled"),
    )


def tile_health(last_error: Column) -> Column:
    return first_rule([(last_error.isNotNull(), 1, last_error)], (0, "Satellite imagery and DEM tile publisher nominal"))


def metrics_health(streams: Column) -> Column:
    return first_rule([(streams <= 0, 0, "No payload metrics published yet")], (0, "Stream payload metrics nominal"))


def provider_status(enabled: Column, has_credentials: Column, recording_allowed: Column) -> Column:
    return (
        F.when(_not(enabled), "disabled")
        .when(_not(has_credentials), "missing_credentials")
        .when(_not(recording_allowed), "recording_not_allowed")
        .otherwise("configured")
    )


def status_values(values: Column) -> Column:
    """MAP<STRING, STRING> to the list of {key, value}, sorted by key."""
    return F.array_sort(F.map_entries(values))
