"""Message types: their fields, and the table contracts that operators share."""

from __future__ import annotations

PACKAGE = "mapping_msgs"

MESSAGE_DDL = "session_id string, chunk string, row_id bigint, topic string, type string, stamp_ns bigint, data string"
TOPIC_DDL = "chunk string, topic_id bigint, name string, type string, serialization_format string, qos string"

# Fixed field lists of the message types (name, type), in message order.
HEADER = (("stamp", (("sec", "int32"), ("nanosec", "uint32"))), ("frame_id", "string"))
POINT = (("x", "float64"), ("y", "float64"), ("z", "float64"))
QUATERNION = (("x", "float64"), ("y", "float64"), ("z", "float64"), ("w", "float64"))
POSE = (("position", POINT), ("orientation", QUATERNION))
GEO_TILE = (
    ("header", HEADER), ("provider", "string"), ("layer", "string"), ("kind", "string"), ("crs", "string"), ("zoom", "uint32"),
    ("tile_x", "uint32"), ("tile_y", "uint32"), ("bounds", "string"), ("device_location", "string"), ("device_pixel_x", "float64"),
    ("device_pixel_y", "float64"), ("tile_width", "uint32"), ("tile_height", "uint32"), ("pixel_origin", "string"),
    ("pixel_units", "string"), ("format", "string"), ("mime_type", "string"), ("source_url", "string"), ("attribution", "string"),
    ("license", "string"), ("source_policy", "string"), ("is_cached", "bool"), ("time", "string"),
)
PUBLISHER_STATS = (
    ("capacity", "uint32"), ("depth", "uint32"), ("in_flight", "uint32"), ("sent_messages", "uint64"), ("dropped_messages", "uint64"),
    ("retried_messages", "uint64"), ("failed_messages", "uint64"), ("last_error", "string"),
)
LOCATION = (
    ("header", HEADER), ("service", "string"), ("latitude", "float64"), ("longitude", "float64"), ("altitude", "float64"),
    ("ellipsoidal_altitude", "float64"), ("horizontal_accuracy", "float64"), ("vertical_accuracy", "float64"), ("speed", "float64"),
    ("speed_accuracy", "float64"), ("course", "float64"), ("course_accuracy", "float64"),
)

MESSAGE_FIELDS: dict[str, tuple] = {
    "geometry_msgs/msg/PoseStamped": (("header", HEADER), ("pose", POSE)),
    "sensor_msgs/msg/NavSatFix": (
        ("header", HEADER), ("status", (("status", "int8"), ("service", "uint16"))), ("latitude", "float64"), ("longitude", "float64"),
        ("altitude", "float64"), ("position_covariance", "float64[9]"), ("position_covariance_type", "uint8"),
    ),
    "sensor_msgs/msg/CompressedImage": (("header", HEADER), ("format", "string"), ("data", "sequence<uint8>")),
    "sensor_msgs/msg/CameraInfo": (
        ("header", HEADER), ("height", "uint32"), ("width", "uint32"), ("distortion_model", "string"), ("d", "sequence<float64>"),
        ("k", "float64[9]"), ("r", "float64[9]"), ("p", "float64[12]"),
    ),
    "sensor_msgs/msg/PointCloud2": (
        ("header", HEADER), ("height", "uint32"), ("width", "uint32"),
        ("fields", [("name", "string"), ("offset", "uint32"), ("datatype", "uint8"), ("count", "uint32")]),
        ("is_bigendian", "bool"), ("point_step", "uint32"), ("row_step", "uint32"), ("data", "sequence<uint8>"), ("is_dense", "bool"),
    ),
    "sensor_msgs/msg/Imu": (
        ("header", HEADER), ("orientation", QUATERNION), ("orientation_covariance", "float64[9]"), ("angular_velocity", POINT),
        ("angular_velocity_covariance", "float64[9]"), ("linear_acceleration", POINT),
        ("linear_acceleration_covariance", "float64[9]"),
    ),
    "tf2_msgs/msg/TFMessage": (
        ("transforms", [("header", HEADER), ("child_frame_id", "string"), ("transform", (("translation", POINT), ("rotation", QUATERNION)))]),
    ),
    "nav_msgs/msg/Odometry": (
        ("header", HEADER), ("child_frame_id", "string"), ("pose", (("pose", POSE), ("covariance", "float64[36]"))),
        ("twist", (("twist", (("linear", POINT), ("angular", POINT))), ("covariance", "float64[36]"))),
    ),
    "diagnostic_msgs/msg/DiagnosticArray": (
        ("header", HEADER),
        ("status", [("level", "uint8"), ("name", "string"), ("message", "string"), ("hardware_id", "string"), ("values", [("key", "string"), ("value", "string")])]),
    ),
    "visualization_msgs/msg/MarkerArray": (
        ("markers", [
            ("header", HEADER), ("ns", "string"), ("id", "int32"), ("type", "int32"), ("action", "int32"), ("pose", POSE), ("scale", POINT),
            ("color", (("r", "float32"), ("g", "float32"), ("b", "float32"), ("a", "float32"))),
            ("points", [("x", "float64"), ("y", "float64"), ("z", "float64")]),
        ]),
    ),
    f"{PACKAGE}/msg/DepthAnythingCalibration": (
        ("header", HEADER), ("schema_version", "uint32"), ("source", "string"), ("relative_pointcloud_topic", "string"),
        ("overlay_mesh_source", "string"), ("frame_id", "string"), ("relative_depth_width", "uint32"), ("relative_depth_height", "uint32"),
        ("image_width", "uint32"), ("image_height", "uint32"), ("scale", "float64"), ("offset", "float64"), ("equation", "string"),
        ("relative_depth_units", "string"), ("metric_depth_units", "string"), ("calibration_source", "string"), ("metadata_json", "string"),
    ),
    f"{PACKAGE}/msg/GPSMetadata": LOCATION + (
        ("timestamp", "string"), ("unix_time", "float64"), ("age_seconds", "float64"), ("validity", "string"), ("source", "string"),
        ("georeference", "string"),
    ),
    f"{PACKAGE}/msg/GeoTileInfo": GEO_TILE,
    f"{PACKAGE}/msg/GeoRasterTile": GEO_TILE + (("encoding", "string"), ("data", "string")),
    f"{PACKAGE}/msg/IndoorLocalization": LOCATION + (
        ("floor_available", "bool"), ("floor_level", "int32"), ("heading_available", "bool"), ("true_heading", "float64"),
        ("magnetic_heading", "float64"), ("heading_accuracy", "float64"), ("source", "string"), ("registration_quality", "string"),
        ("timestamp", "string"),
    ),
    f"{PACKAGE}/msg/MappingSession": (
        ("header", HEADER), ("event", "string"), ("session_id", "string"), ("state", "string"), ("recorder_url", "string"),
        ("bridge_transport", "string"), ("enabled_streams", "sequence<string>"), ("advertised_topics", "string"), ("radio_channels", "string"),
        ("radio_platform_restrictions", "string"), ("radio_observation_schema", "string"), ("mesh_snapshot_schema", "string"),
        ("stream_payload_metrics", "string"), ("optional_geo_provider_configurations", "string"), ("current_wifi_telemetry", "string"),
        ("ble_beacon_telemetry", "string"), ("network_path_diagnostics", "string"), ("recorder_endpoint_probe", "string"),
        ("local_bag_storage", "string"), ("started_at", "string"), ("ended_at", "string"), ("app", "string"), ("device", "string"),
        ("publish_queue", PUBLISHER_STATS), ("last_error", "string"),
    ),
    f"{PACKAGE}/msg/MeshSnapshot": (
        ("header", HEADER), ("schema_version", "uint32"), ("snapshot_id", "string"), ("source", "string"), ("frame_id", "string"),
        ("anchor_count", "uint32"), ("vertex_count", "uint32"), ("triangle_count", "uint32"), ("original_vertex_count", "uint32"),
        ("original_triangle_count", "uint32"), ("is_truncated", "bool"), ("original_payload_bytes", "uint32"),
        ("published_payload_bytes", "uint32"), ("compression", "string"), ("vertex_encoding", "string"), ("vertex_stride_bytes", "uint32"),
        ("vertex_data", "sequence<uint8>"), ("index_encoding", "string"), ("index_stride_bytes", "uint32"), ("index_data", "sequence<uint8>"),
        ("metadata_json", "string"),
    ),
    f"{PACKAGE}/msg/PublisherStats": PUBLISHER_STATS,
    f"{PACKAGE}/msg/RadioObservation": (
        ("header", HEADER), ("session_id", "string"), ("schema_version", "uint32"), ("channel_id", "string"), ("observation_kind", "string"),
        ("source_api", "string"), ("source_id", "string"), ("radio_type", "string"), ("tags", "sequence<string>"),
        ("map_position_available", "bool"), ("map_position", POINT), ("geodetic_position_available", "bool"), ("latitude", "float64"),
        ("longitude", "float64"), ("altitude", "float64"), ("ssid", "string"), ("bssid", "string"), ("signal_strength_normalized", "float64"),
        ("is_secure", "bool"), ("peripheral_id", "string"), ("local_name", "string"), ("service_uuids", "sequence<string>"),
        ("is_connectable", "bool"), ("network_status", "string"), ("interface_types", "sequence<string>"), ("is_expensive", "bool"),
        ("is_constrained", "bool"), ("frequency_hz", "float64"), ("rssi_dbm", "float64"), ("snr_db", "float64"), ("quality", "float64"),
        ("round_trip_time_ms", "float64"), ("throughput_bytes_per_second", "float64"), ("success", "bool"), ("error", "string"),
        ("metadata_json", "string"),
    ),
}
