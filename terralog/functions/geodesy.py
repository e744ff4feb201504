"""WGS84 positions, east-north-up offsets and the local map frame (x = east, y = up, z = -north)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralog.functions.numeric import is_finite, let

# Fixed values of WGS84.
SEMI_MAJOR_M = 6378137.0
ECCENTRICITY_SQUARED = 6.69437999014e-3


def usable_fix(lat: Column, lon: Column, alt: Column) -> Column:
    return is_finite(lat) & is_finite(lon) & is_finite(alt)


def to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(SEMI_MAJOR_M) / F.sqrt(F.lit(1.0) - F.lit(ECCENTRICITY_SQUARED) * F.sin(phi) * F.sin(phi))
    return F.struct(
        ((n + alt) * F.cos(phi) * F.cos(lam)).alias("x"),
        ((n + alt) * F.cos(phi) * F.sin(lam)).alias("y"),
        ((n * F.lit(1.0 - ECCENTRICITY_SQUARED) + alt) * F.sin(phi)).alias("z"),
    )


def _axes(lat: Column, lon: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """East, north and up unit vectors in earth-centred axes."""
    phi, lam = F.radians(lat), F.radians(lon)
    sp, cp, sl, cl = F.sin(phi), F.cos(phi), F.sin(lam), F.cos(lam)
    return [-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def to_enu(ecef: Column, origin_ecef: Column, origin_lat: Column, origin_lon: Column) -> Column:
    delta = [ecef[c] - origin_ecef[c] for c in "xyz"]
    east, north, up = _axes(origin_lat, origin_lon)
    return F.struct(_dot(east, delta).alias("e"), _dot(north, delta).alias("n"), _dot(up, delta).alias("u"))


def enu_to_map(enu: Column, origin_map: Column) -> Column:
    return F.struct(
        (origin_map["x"] + enu["e"]).alias("x"), (origin_map["y"] + enu["u"]).alias("y"), (origin_map["z"] - enu["n"]).alias("z")
    )


def quaternion(m: Sequence[Sequence[Column]]) -> Column:
    """Unit quaternion {qx, qy, qz, qw} of a rotation given by rows; the largest component is found first."""
    trace = m[0][0] + m[1][1] + m[2][2]

    def of(x: Column, y: Column, z: Column, w: Column) -> Column:
        length = F.sqrt(x * x + y * y + z * z + w * w)
        return F.struct((x / length).alias("qx"), (y / length).alias("qy"), (z / length).alias("qz"), (w / length).alias("qw"))

    one = F.lit(1.0)
    by_w = of(m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1], one + trace)
    by_x = of(one + m[0][0] - m[1][1] - m[2][2], m[0][1] + m[1][0], m[0][2] + m[2][0], m[2][1] - m[1][2])
    by_y = of(m[0][1] + m[1][0], one - m[0][0] + m[1][1] - m[2][2], m[1][2] + m[2][1], m[0][2] - m[2][0])
    by_z = of(m[0][2] + m[2][0], m[1][2] + m[2][1], one - m[0][0] - m[1][1] + m[2][2], m[1][0] - m[0][1])
    return (
        F.when(trace >= 0, by_w)
        .when((m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), by_x)
        .when(m[1][1] >= m[2][2], by_y)
        .otherwise(by_z)
    )


def earth_to_map(origin_lat: Column, origin_lon: Column, origin_ecef: Column, origin_map: Column) -> Column:
    """Pose of the map frame in earth-centred axes: {tx, ty, tz, rotation{qx, qy, qz, qw}}."""
    east, north, up = _axes(origin_lat, origin_lon)
    matrix = F.array(*[v for i in range(3) for v in (east[i], up[i], -north[i])])

    def frame(m: Column) -> Column:
        rows = [[m[r * 3 + c] for c in range(3)] for r in range(3)]
        at = [origin_map[c] for c in "xyz"]
        shift = [(origin_ecef[c] - _dot(rows[i], at)).alias(f"t{c}") for i, c in enumerate("xyz")]
        return F.struct(*shift, quaternion(rows).alias("rotation"))

    return let(matrix, frame)


def pose_from_matrix(m: Column) -> Column:
    """4x4 row-major array to {x, y, z, rotation{qx, qy, qz, qw}}."""
    rows = [[m[r * 4 + c] for c in range(3)] for r in range(3)]
    return F.struct(m[3].alias("x"), m[7].alias("y"), m[11].alias("z"), quaternion(rows).alias("rotation"))
