"""Pixels, colours, camera matrices and depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralog.functions.numeric import clamp, is_finite

MIN_METRIC_DEPTH = 0.1
MIN_FOCAL = 1e-5


def camera_matrices(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """{k[9], r[9], p[12], d[5]} of an undistorted camera."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.struct(
        F.array(fx, zero, cx, zero, fy, cy, zero, zero, one).alias("k"),
        F.array(one, zero, zero, zero, one, zero, zero, zero, one).alias("r"),
        F.array(fx, zero, cx, zero, zero, fy, cy, zero, zero, zero, one, zero).alias("p"),
        F.array_repeat(zero, 5).alias("d"),
    )


def diag_covariance(*diagonal: float | Column) -> Column:
    """6x6 row-major with the given diagonal."""
    values = F.array(*[d if isinstance(d, Column) else F.lit(float(d)) for d in diagonal])
    return F.transform(
        F.sequence(F.lit(0), F.lit(35)),
        lambda i: F.when(i % 7 == 0, F.coalesce(F.get(values, (i / 7).cast("int")), F.lit(0.0))).otherwise(F.lit(0.0)),
    )


# Fixed diagonals of the odometry message.
POSE_DIAGONAL = (0.0025, 0.0025, 0.0025, 0.0004, 0.0004, 0.0004)
TWIST_DIAGONAL = (0.04, 0.04, 0.04, 0.01, 0.01, 0.01)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Full-range BT.601, clamped and cut to whole numbers; white where there is no image."""
    u, v = cb - F.lit(128.0), cr - F.lit(128.0)

    def channel(value: Column) -> Column:
        cut = clamp(value, 0.0, 255.0).cast("smallint")
        return F.when(y.isNull() | cb.isNull() | cr.isNull(), F.lit(255).cast("smallint")).otherwise(cut)

    return F.struct(
        channel(y + F.lit(1.402) * v).alias("r"),
        channel(y - F.lit(0.344136) * u - F.lit(0.714136) * v).alias("g"),
        channel(y + F.lit(1.772) * u).alias("b"),
    )


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def unpack_rgb(rgb: Column) -> Column:
    def channel(shift: int) -> Column:
        return F.shiftright(rgb.cast("int"), shift).bitwiseAND(F.lit(255)).cast("smallint")

    return F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b"))


def calibrated_depth(relative: Column, scale: Column, offset: Column) -> Column:
    """Metric depth, or null where the relative or the metric value is not usable."""
    depth = scale * relative + offset
    return F.when(is_finite(relative) & (relative > 0) & is_finite(depth) & (depth > F.lit(MIN_METRIC_DEPTH)), depth)


def affine_depth(relative: Column, a: Column, b: Column) -> Column:
    return a * relative + b


def unproject(
    px: Column, py: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column,
    image_size: tuple[Column, Column], depth_size: tuple[Column, Column],
) -> Column:
    """Camera-frame {x, y, z} of a depth pixel; null when the sizes or focal lengths cannot be used."""
    sx = depth_size[0].cast("double") / image_size[0]
    sy = depth_size[1].cast("double") / image_size[1]
    fx, fy, cx, cy = fx * sx, fy * sy, cx * sx, cy * sy
    usable = (
        (depth_size[0] > 0) & (depth_size[1] > 0) & (image_size[0] > 0) & (image_size[1] > 0)
        & is_finite(fx) & is_finite(fy) & is_finite(cx) & is_finite(cy)
        & (F.abs(fx) > F.lit(MIN_FOCAL)) & (F.abs(fy) > F.lit(MIN_FOCAL))
    )
    return F.when(
        usable,
        F.struct(((px - cx) / fx * depth).alias("x"), ((cy - py) / fy * depth).alias("y"), (-depth).alias("z")),
    )


def to_map(point: Column, m: Column) -> Column:
    """4x4 row-major transform times (x, y, z, 1)."""
    def row(i: int) -> Column:
        return m[i * 4] * point["x"] + m[i * 4 + 1] * point["y"] + m[i * 4 + 2] * point["z"] + m[i * 4 + 3]

    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))
