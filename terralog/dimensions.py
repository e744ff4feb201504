"""Small reference tables with a fixed number of rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.schemas import PACKAGE

# Topic id, stream, topic, type, rate in Hz (None: on change), implemented.
TOPICS = (
    ("pose", "pose", "/mapping/pose", "geometry_msgs/msg/PoseStamped", 30.0, True),
    ("lidarPointCloud", "pointCloud", "/mapping/pointcloud/lidar", "sensor_msgs/msg/PointCloud2", 5.0, True),
    ("depthAnythingPointCloud", "pointCloud", "/mapping/pointcloud/depth_anything", "sensor_msgs/msg/PointCloud2", 5.0, True),
    ("depthAnythingCalibration", "pointCloud", "/mapping/depth_anything/calibration", f"{PACKAGE}/msg/DepthAnythingCalibration", 5.0, True),
    ("imu", "imu", "/mapping/imu", "sensor_msgs/msg/Imu", 100.0, True),
    ("meshMarkers", "mesh", "/mapping/map", "visualization_msgs/msg/MarkerArray", 0.5, True),
    ("meshSnapshot", "mesh", "/mapping/mesh_snapshot", f"{PACKAGE}/msg/MeshSnapshot", 0.5, True),
    ("tf", "tf", "/tf", "tf2_msgs/msg/TFMessage", 30.0, True),
    ("cameraCompressed", "camera", "/mapping/camera/image/compressed", "sensor_msgs/msg/CompressedImage", 2.0, True),
    ("cameraInfo", "camera", "/mapping/camera/camera_info", "sensor_msgs/msg/CameraInfo", 2.0, True),
    ("surfels", "surfels", "/mapping/surfels", "sensor_msgs/msg/PointCloud2", 1.0, False),
    ("gpsFix", "gps", "/mapping/gps/fix", "sensor_msgs/msg/NavSatFix", 1.0, True),
    ("gpsMetadata", "gps", "/mapping/gps/metadata", f"{PACKAGE}/msg/GPSMetadata", 1.0, True),
    ("odom", "odometry", "/mapping/odom", "nav_msgs/msg/Odometry", 30.0, True),
    ("status", "diagnostics", "/mapping/status", "diagnostic_msgs/msg/DiagnosticArray", 1.0, True),
    ("session", "session", "/mapping/session", f"{PACKAGE}/msg/MappingSession", None, True),
    ("radio", "radio", "/mapping/radio", f"{PACKAGE}/msg/RadioObservation", 2.0, True),
    ("indoorLocalization", "indoorLocalization", "/mapping/indoor_localization", f"{PACKAGE}/msg/IndoorLocalization", 1.0, True),
    ("satelliteImage", "satelliteImagery", "/mapping/satellite/image/compressed", "sensor_msgs/msg/CompressedImage", 1.0 / 60.0, True),
    ("satelliteTileInfo", "satelliteImagery", "/mapping/satellite/tile_info", f"{PACKAGE}/msg/GeoTileInfo", 1.0 / 60.0, True),
    ("demTile", "dem", "/mapping/dem/tile", f"{PACKAGE}/msg/GeoRasterTile", 1.0 / 60.0, True),
)
TOPIC_DDL = "topic_id string, stream string, topic string, type string, rate_hz double, is_implemented boolean"

# Streams that are on unless the user changes them.
DEFAULT_STREAMS = ("pose", "camera", "pointCloud", "gps", "satelliteImagery", "dem")

# Radio channel, name, source, rate, public interface, required capabilities, limitations.
RADIO_CHANNELS = (
    ("current_wifi_network", "Current Wi-Fi Network", "NetworkExtension.NEHotspotNetwork.fetchCurrent", 0.5, True,
     ["Location permission", "Access WiFi Information entitlement"],
     ["Reports only the current associated Wi-Fi network.", "Does not provide broad Wi-Fi scan results.",
      "Signal strength is normalized by iOS rather than raw RSSI dBm."]),
    ("ble_advertisement", "BLE Advertisement RSSI", "CoreBluetooth.CBCentralManager", 2.0, True,
     ["Bluetooth permission", "Configured service UUIDs or known peripheral filters"],
     ["Scanning should be scoped to configured beacons or peripherals.", "Background scan behavior is limited by iOS policy."]),
    ("network_path", "Network Path State", "Network.NWPathMonitor", 1.0, True,
     ["Local network permission when connecting to a local recorder"],
     ["Reports path and interface characteristics, not RF signal power."]),
    ("recorder_latency_probe", "Recorder Latency Probe", "URLSessionWebSocketTask and Network.framework", 0.5, True,
     ["Reachable ROS2 recorder endpoint"],
     ["Measures application-path latency to the recorder, not raw link-layer latency.",
      "Throughput probe measures bounded rosbridge upload write rate, not sustained bidirectional bandwidth."]),
    ("external_adapter", "External Radio Adapter", "ExternalAccessory, BLE, local network, or companion ROS2 node", None, False,
     ["Configured external sensor or adapter integration"],
     ["Requires hardware-specific integration.",
      "Used for cellular, spectrum, or router metrics unavailable through normal iOS APIs."]),
)
RADIO_CHANNEL_DDL = (
    "channel_id string, display_name string, source_api string, rate_hz double, is_public boolean, "
    "required_capabilities array<string>, limitations array<string>"
)

# Platform restriction, title, channels it affects.
PLATFORM_RESTRICTIONS = (
    ("ios_no_broad_wifi_scans", "No Broad Wi-Fi Scans", ["current_wifi_network"]),
    ("ios_no_reliable_public_cellular_rf_metrics", "No Reliable Public Cellular RSSI/RSRP Stream", ["network_path", "external_adapter"]),
    ("ios_scoped_ble_scanning", "Scoped BLE Scanning", ["ble_advertisement"]),
)
PLATFORM_RESTRICTION_DDL = "restriction_id string, title string, affected_channels array<string>"

# The default tile providers.
PROVIDERS = (
    dict(
        kind="satellite_imagery", name="NASA GIBS", layer="MODIS_Terra_CorrectedReflectance_TrueColor", zoom=9, crs="EPSG:3857",
        format="jpeg", mime="image/jpeg", extension="jpg", encoding="wmts_jpeg", tile_size=256,
        attribution="NASA Global Imagery Browse Services (GIBS)",
        license="NASA Earthdata open-data guidance; retain GIBS attribution and layer/date metadata",
        policy_url="https://www.earthdata.nasa.gov/engage/open-data-services-software-policies/data-information-guidance",
        credential="none", recordable=True, is_global=True, date_offset_days=-2,
        template="https://gibs.earthdata.nasa.gov/wmts/epsg3857/best/MODIS_Terra_CorrectedReflectance_TrueColor/default/{date}/GoogleMapsCompatible_Level9/{z}/{y}/{x}.jpg",
    ),
    dict(
        kind="dem", name="USGS 3DEP", layer="3DEPElevation", zoom=12, crs="EPSG:3857", format="tiff", mime="image/tiff", extension="tif",
        encoding="usgs_3dep_float32_tiff", tile_size=256, attribution="USGS 3D Elevation Program (3DEP) through The National Map",
        license="USGS public data; retain USGS 3DEP and The National Map attribution",
        policy_url="https://www.usgs.gov/information-policies-and-instructions/copyrights-and-credits",
        credential="none", recordable=True, is_global=False, date_offset_days=None,
        template="https://elevation.nationalmap.gov/arcgis/rest/services/3DEPElevation/ImageServer/exportImage?bbox={bbox}&bboxSR=3857&imageSR=3857&size=256,256&format=tiff&pixelType=F32&interpolation=RSP_BilinearInterpolation&f=image",
    ),
    dict(
        kind="dem", name="Mapzen Terrain Tiles", layer="terrarium", zoom=12, crs="EPSG:3857", format="png", mime="image/png", extension="png",
        encoding="terrarium_png", tile_size=256,
        attribution="Mapzen Terrain Tiles; source data includes USGS, SRTM, and other regional DEM sources",
        license="Mapzen Terrain Tiles attribution requirements; underlying source attribution varies by region",
        policy_url="https://github.com/tilezen/joerd/blob/master/docs/attribution.md",
        credential="none", recordable=True, is_global=True, date_offset_days=None,
        template="https://s3.amazonaws.com/elevation-tiles-prod/terrarium/{z}/{x}/{y}.png",
    ),
)
PROVIDER_DDL = (
    "kind string, name string, layer string, zoom int, crs string, format string, mime string, extension string, encoding string, "
    "tile_size int, attribution string, license string, policy_url string, credential string, recordable boolean, is_global boolean, "
    "date_offset_days int, template string"
)

# Coverage boxes of regional providers (provider, box, south, west, north, east).
REGIONS = (
    ("USGS 3DEP", "Conterminous United States", 24.0, -125.0, 50.0, -66.0),
    ("USGS 3DEP", "Alaska", 51.0, 172.0, 72.0, -129.0),
    ("USGS 3DEP", "Hawaii", 18.0, -161.0, 23.0, -154.0),
    ("USGS 3DEP", "Puerto Rico and US Virgin Islands", 17.0, -68.0, 19.0, -64.0),
    ("USGS 3DEP", "Guam and Northern Mariana Islands", 13.0, 144.0, 21.0, 147.0),
    ("USGS 3DEP", "American Samoa", -15.0, -172.0, -11.0, -168.0),
)
REGION_DDL = "name string, region string, south double, west double, north double, east double"

# Provider slots a user may fill in (id, name, kind, credential, endpoint).
OPTIONAL_PROVIDERS = (
    ("copernicus_data_space", "Copernicus Data Space", "satellite_imagery", "user_login", "https://catalogue.dataspace.copernicus.eu/odata/v1"),
    ("open_topography", "OpenTopography", "dem", "user_api_key", "https://portal.opentopography.org/API"),
    ("usgs_eros_earthdata", "USGS EROS / Earthdata", "dem", "user_login", "https://m2m.cr.usgs.gov/api/api/json/stable"),
    ("commercial_imagery", "Commercial Imagery", "satellite_imagery", "commercial_account", ""),
    ("commercial_terrain", "Commercial Terrain", "dem", "commercial_account", ""),
)
OPTIONAL_PROVIDER_DDL = "provider_id string, display_name string, kind string, credential string, endpoint_url string"

# Target load (profile, topic, rate in Hz, payload bytes).
RATE_TARGETS = (
    ("camera", "/mapping/camera/image/compressed", 10.0, 92_000),
    ("lidar-point-cloud", "/mapping/pointcloud/lidar", 5.0, 110_000),
    ("depth-anything-point-cloud", "/mapping/pointcloud/depth_anything", 5.0, 220_000),
    ("depth-anything-calibration", "/mapping/depth_anything/calibration", 5.0, 1_024),
    ("mesh", "/mapping/mesh_snapshot", 0.5, 512_000),
    ("satellite", "/mapping/satellite/image/compressed", 1.0 / 60.0, 160_000),
    ("dem", "/mapping/dem/tile", 1.0 / 60.0, 262_144),
)
RATE_TARGET_DDL = "profile string, topic string, rate_hz double, payload_bytes bigint"

# Topics recorded by default, and those recorded on request.
RECORDED_TOPICS = (
    "/mapping/pose", "/mapping/camera/image/compressed", "/mapping/camera/camera_info", "/mapping/pointcloud/lidar",
    "/mapping/pointcloud/depth_anything", "/mapping/depth_anything/calibration", "/mapping/gps/fix", "/mapping/gps/metadata",
    "/mapping/satellite/image/compressed", "/mapping/satellite/tile_info", "/mapping/dem/tile",
)
OPTIONAL_TOPICS = (
    "/tf", "/mapping/odom", "/mapping/imu", "/mapping/map", "/mapping/mesh_snapshot", "/mapping/radio", "/mapping/indoor_localization",
    "/mapping/session", "/mapping/status",
)


def load_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    def table(rows: Sequence, ddl: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(rows), ddl))

    names = [c.split(" ")[0] for c in PROVIDER_DDL.split(", ")]
    return {
        "topics": table(TOPICS, TOPIC_DDL),
        "radio_channels": table(RADIO_CHANNELS, RADIO_CHANNEL_DDL),
        "platform_restrictions": table(PLATFORM_RESTRICTIONS, PLATFORM_RESTRICTION_DDL),
        "providers": table([tuple(p[n] for n in names) for p in PROVIDERS], PROVIDER_DDL),
        "regions": table(REGIONS, REGION_DDL),
        "optional_providers": table(OPTIONAL_PROVIDERS, OPTIONAL_PROVIDER_DDL),
        "rate_targets": table(RATE_TARGETS, RATE_TARGET_DDL),
    }


def listed(rows: Sequence[Sequence], ddl: str) -> Column:
    """A fixed table as JSON text, a constant of the plan."""
    names = [c.split(" ")[0] for c in ddl.split(", ")]
    return F.lit(json.dumps([dict(zip(names, row)) for row in rows]))


def provider_array(providers: Sequence[dict] = PROVIDERS, regions: Sequence[tuple] = REGIONS) -> Column:
    """The providers, each with its boxes, as a constant array: rows look up their providers without any join."""
    kinds = dict(c.split(" ") for c in PROVIDER_DDL.split(", "))

    def one(position: int, provider: dict) -> Column:
        boxes = [F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("south", "west", "north", "east"), r[2:])]) for r in regions if r[0] == provider["name"]]
        listed = F.array(*boxes) if boxes else F.array().cast("array<struct<south:double,west:double,north:double,east:double>>")
        columns = [F.lit(provider[n]).cast(k).alias(n) for n, k in kinds.items()]
        return F.struct(F.lit(position).alias("position"), *columns, listed.alias("boxes"))

    return F.array(*[one(i, p) for i, p in enumerate(providers)])


def advertised_topics(enabled_streams: Column, topics: Sequence[tuple] = TOPICS) -> Column:
    """JSON text of the implemented topics whose stream is enabled."""
    rows = [
        F.struct(
            F.lit(t[0]).alias("id"), F.lit(t[1]).alias("stream"), F.lit(t[2]).alias("topic"), F.lit(t[3]).alias("message_type"),
            F.lit("" if t[4] is None else str(t[4])).alias("default_rate_hz"),
        )
        for t in topics if t[5]
    ]
    return F.to_json(F.filter(F.array(*rows), lambda t: F.array_contains(enabled_streams, t["stream"])))
