"""Web-mercator tiles and geographic boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralog.functions.numeric import fixed, whole_div

# Fixed values of the web-mercator scheme.
MAX_LATITUDE = 85.05112878
EARTH_RADIUS_M = 6378137.0
UNSAFE_PATH_CHARS = r"[^\p{L}\p{M}\p{N}_.-]"


def _tile_count(zoom: Column) -> Column:
    return F.pow(F.lit(2.0), zoom.cast("double"))


def _fraction(lat: Column, lon: Column, zoom: Column) -> tuple[Column, Column]:
    """Position in tile units, from the north-west corner."""
    rad = F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)) * F.lit(math.pi) / F.lit(180.0)
    n = _tile_count(zoom)
    x = (lon + F.lit(180.0)) / F.lit(360.0) * n
    y = (F.lit(1.0) - F.ln(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)) / F.lit(2.0) * n
    return x, y


def tile_key(lat: Column, lon: Column, zoom: Column) -> Column:
    """{z, x, y}; positions outside the map fall on its border tiles."""
    top = _tile_count(zoom) - F.lit(1)
    x, y = (F.least(F.greatest(F.floor(v).cast("double"), F.lit(0.0)), top).cast("int") for v in _fraction(lat, lon, zoom))
    return F.struct(zoom.cast("int").alias("z"), x.alias("x"), y.alias("y"))


def tile_pixel(lat: Column, lon: Column, key: Column, size: Column) -> Column:
    """{px, py} inside the tile, origin upper left."""
    fx, fy = _fraction(lat, lon, key["z"])
    size = size.cast("double")

    def inside(fraction: Column, index: Column) -> Column:
        return F.least(F.greatest((fraction - index) * size, F.lit(0.0)), size)

    return F.struct(inside(fx, key["x"]).alias("px"), inside(fy, key["y"]).alias("py"))


def tile_bounds(key: Column) -> Column:
    """{west, south, east, north} in degrees."""
    n = _tile_count(key["z"])

    def lon(x: Column) -> Column:
        return x.cast("double") / n * F.lit(360.0) - F.lit(180.0)

    def lat(y: Column) -> Column:
        return F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * y.cast("double") / n))) * F.lit(180.0) / F.lit(math.pi)

    return F.struct(
        lon(key["x"]).alias("west"), lat(key["y"] + 1).alias("south"), lon(key["x"] + 1).alias("east"), lat(key["y"]).alias("north")
    )


def tile_bounds_3857(key: Column) -> Column:
    """{min_x, min_y, max_x, max_y} in metres."""
    edge = math.pi * EARTH_RADIUS_M
    width = F.lit(edge * 2.0) / _tile_count(key["z"])
    return F.struct(
        (F.lit(-edge) + key["x"] * width).alias("min_x"),
        (F.lit(edge) - (key["y"] + 1) * width).alias("min_y"),
        (F.lit(-edge) + (key["x"] + 1) * width).alias("max_x"),
        (F.lit(edge) - key["y"] * width).alias("max_y"),
    )


def bbox_param(bounds: Column) -> Column:
    return F.concat_ws(",", *[fixed(bounds[c]) for c in ("min_x", "min_y", "max_x", "max_y")])


def tile_date(stamp: Column, offset_days: Column) -> Column:
    """UTC day moved by the provider's offset; null where the provider has none.  ``stamp`` is nanoseconds."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole_div(stamp, 86400 * 10**9).cast("int") + offset_days)
    return F.date_format(day, "yyyy-MM-dd")


def tile_source(template: Column, key: Column, date: Column) -> Column:
    """Request text: ``{z} {x} {y} {date} {bbox}`` filled in; null when a needed date is missing."""
    text = F.replace(template, F.lit("{z}"), key["z"].cast("string"))
    text = F.replace(text, F.lit("{x}"), key["x"].cast("string"))
    text = F.replace(text, F.lit("{y}"), key["y"].cast("string"))
    text = F.replace(text, F.lit("{bbox}"), bbox_param(tile_bounds_3857(key)))
    return F.when(F.contains(template, F.lit("{date}")), F.replace(text, F.lit("{date}"), date)).otherwise(text)


def safe_component(text: Column) -> Column:
    return F.regexp_replace(text, UNSAFE_PATH_CHARS, "_")


def tile_cache_path(name: Column, layer: Column, date: Column, key: Column, extension: Column) -> Column:
    return F.concat_ws(
        "/",
        safe_component(name),
        safe_component(layer),
        F.coalesce(safe_component(date), F.lit("static")),
        key["z"].cast("string"),
        key["x"].cast("string"),
        F.concat(key["y"].cast("string"), F.lit("."), extension),
    )


def tile_id(kind: Column, name: Column, layer: Column, date: Column, key: Column) -> Column:
    return F.concat_ws(
        "|", kind, name, layer, F.coalesce(date, F.lit("static")), key["z"].cast("string"), key["x"].cast("string"), key["y"].cast("string")
    )


def normal_longitude(lon: Column) -> Column:
    """Whole turns taken off until the value is in [-180, 180]; both ends stay as they are."""
    turned = (
        F.when(lon > 180, lon - F.lit(360.0) * F.ceil((lon - 180) / F.lit(360.0)))
        .when(lon < -180, lon + F.lit(360.0) * F.ceil((F.lit(-180.0) - lon) / F.lit(360.0)))
    )
    return F.coalesce(turned, lon)


def region_contains(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Inside a box, borders included; a box whose west is greater than its east crosses the date line."""
    x, w, e = normal_longitude(lon), normal_longitude(west), normal_longitude(east)
    return (lat >= south) & (lat <= north) & F.when(w <= e, (x >= w) & (x <= e)).otherwise((x >= w) | (x <= e))
