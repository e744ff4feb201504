"""Point clouds: from depth, thinning, outliers, surfels, artifacts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions import camera
from terralog.functions.numeric import clamp, is_finite
from terralog.operators.ordered import OrderedRows, key_stream

VOXEL = ("vx", "vy", "vz")
LIDAR_STEP = 4
FUSION_CAP = 64
SURFEL_VOXEL_M = 0.04


# --- clouds from depth -------------------------------------------------------------------------------------------------


def _projected(depth: DataFrame, intrinsics: DataFrame, value: Column, in_map: bool, frame: str) -> DataFrame:
    """Depth pixels as coloured points; the intrinsics hold one row per frame (sizes, focal lengths, transform ``m``)."""
    joined = depth.withColumn("_d", value).filter(F.col("_d").isNotNull()).join(intrinsics, frame)
    c = F.col
    point = camera.unproject(
        c("px"), c("py"), c("_d"), c("fx"), c("fy"), c("cx"), c("cy"), (c("image_w"), c("image_h")), (c("depth_w"), c("depth_h"))
    )
    at = joined.withColumn("_p", point).filter(F.col("_p").isNotNull())
    if in_map:
        at = at.withColumn("_p", camera.to_map(F.col("_p"), F.col("m")))
    colour = camera.ycbcr_to_rgb(c("luma"), c("cb"), c("cr")) if "luma" in depth.columns else F.struct(*[F.lit(255).cast("smallint").alias(k) for k in "rgb"])
    return at.select(frame, "px", "py", F.col("_d").alias("depth"), "_p.*", colour.alias("_c")).select(frame, "px", "py", "depth", "x", "y", "z", "_c.*")


def lidar_cloud(depth: DataFrame, intrinsics: DataFrame, frame: str = "frame") -> DataFrame:
    """Every fourth pixel with 0.1 < depth < 5, in the map frame."""
    d = F.col("depth")
    kept = depth.filter((F.col("px") % LIDAR_STEP == 0) & (F.col("py") % LIDAR_STEP == 0) & is_finite(d) & (d > 0.1) & (d < 5.0))
    return _projected(kept, intrinsics, d, True, frame)


def dense_cloud(depth: DataFrame, intrinsics: DataFrame, frame: str = "frame") -> DataFrame:
    """Every pixel deeper than 0.1, in the map frame."""
    d = F.col("depth")
    return _projected(depth.filter(is_finite(d) & (d > 0.1)), intrinsics, d, True, frame)


def relative_cloud(depth: DataFrame, intrinsics: DataFrame, frame: str = "frame") -> DataFrame:
    """Every pixel with a usable relative depth, in the camera frame."""
    r = F.col("relative")
    return _projected(depth.filter(is_finite(r) & (r > 1e-6) & (r < 1e4)), intrinsics, r, False, frame)


def calibrated_cloud(depth: DataFrame, intrinsics: DataFrame, calibration: DataFrame, frame: str = "frame") -> DataFrame:
    """Relative depth made metric with its frame's calibration (``scale, offset``), in the map frame."""
    joined = depth.join(calibration.select(frame, "scale", "offset"), frame)
    return _projected(joined, intrinsics, camera.calibrated_depth(F.col("relative"), F.col("scale"), F.col("offset")), True, frame)


# --- voxels ------------------------------------------------------------------------------------------------------------


def voxel_columns(size: float) -> dict[str, Column]:
    """Cell of a point: floor of coordinate over size."""
    return {v: F.floor(F.col(c) / F.lit(size)).cast("bigint") for v, c in zip(VOXEL, "xyz")}


def voxel_filter(points: DataFrame, size: float, order: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """First point per cell in arrival order, as an aggregation that thins before the shuffle."""
    cells = points.withColumns(voxel_columns(size))
    rest = [c for c in points.columns if c not in key]
    first = cells.groupBy(*key, *VOXEL).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_p"))
    return first.select(*key, "_p.*", *VOXEL)


def voxel_counts(points: DataFrame, size: float, key: Sequence[str] = ()) -> DataFrame:
    return points.withColumns(voxel_columns(size)).groupBy(*key, *VOXEL).agg(F.count("*").alias("points"))


def neighbor_counts(counts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Points in the 27 cells around each cell (itself included).

    Only occupied cells are spread, not points: each cell sends its count to its 27 neighbours, partial sums are built
    before the shuffle, and cells that nobody occupies are dropped.
    """
    steps = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y"), F.lit(dz).alias("z")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)])
    sent = counts.withColumn("_s", F.explode(steps))
    moved = {v: F.col(v) + F.col(f"_s.{c}") for v, c in zip(VOXEL, "xyz")}
    centre = (F.col("_s.x") == 0) & (F.col("_s.y") == 0) & (F.col("_s.z") == 0)
    targets = sent.withColumn("_own", centre).withColumns(moved)
    around = targets.groupBy(*key, *VOXEL).agg(F.sum("points").alias("neighbors"), F.max("_own").alias("_occupied"))
    return around.filter("_occupied").drop("_occupied")


def remove_outliers(points: DataFrame, max_distance: float = 20.0, radius: float = 0.2, k: int = 3, key: Sequence[str] = ()) -> DataFrame:
    """Points nearer than ``max_distance`` whose 27 cells hold more than ``k`` points."""
    near = points.filter(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) < max_distance)
    dense = neighbor_counts(voxel_counts(near, radius, key), key).filter(F.col("neighbors") > k).drop("neighbors")
    return near.withColumns(voxel_columns(radius)).join(dense, [*key, *VOXEL], "left_semi").drop(*VOXEL)


# --- surfels -----------------------------------------------------------------------------------------------------------


def units(v: np.ndarray) -> np.ndarray:
    """Each row at unit length; (0, 1, 0) where it has none."""
    length = np.sqrt(v[:, :1] * v[:, :1] + v[:, 1:2] * v[:, 1:2] + v[:, 2:] * v[:, 2:])
    usable = np.isfinite(length) & (length > 1e-6)
    return np.where(usable, v / np.where(usable, length, 1.0), [0.0, 1.0, 0.0])


def fold_observations(state: Sequence, values: Sequence[Sequence[float]], ways: Sequence[Sequence[float]]) -> tuple[int, list[float], list[float]]:
    """(number, six running means, blended unit normal) of a surfel after more observations, one after the other.

    Plain floats: on arrays of three and six numbers a row costs ten times as much.
    """
    n, mean, normal = state
    if n == 0:
        n, mean, normal, values, ways = 1, values[0], ways[0], values[1:], ways[1:]
    (a, b, c, d, e, f), (x, y, z) = mean, normal
    for (va, vb, vc, vd, ve, vf), (vx, vy, vz) in zip(values, ways):
        w = n if n < FUSION_CAP else FUSION_CAP
        m = w + 1
        a, b, c, d, e, f = (a * w + va) / m, (b * w + vb) / m, (c * w + vc) / m, (d * w + vd) / m, (e * w + ve) / m, (f * w + vf) / m
        x, y, z = x * w + vx, y * w + vy, z * w + vz
        length = math.sqrt(x * x + y * y + z * z)
        x, y, z = (x / length, y / length, z / length) if math.isfinite(length) and length > 1e-6 else (0.0, 1.0, 0.0)
        n += 1
    return n, [a, b, c, d, e, f], [x, y, z]


def surfel_weights(index: Column, total: Column) -> Column:
    """Weight of observation ``index`` (from 1) among ``total`` in a running mean whose weight stops growing at 64."""
    cap = FUSION_CAP + 1
    decay = F.pow(F.lit((cap - 1) / cap), (total - F.greatest(index, F.lit(cap))).cast("double"))
    return F.when(total <= cap, F.lit(1.0) / total).otherwise(F.lit(1.0 / cap) * decay)


def fuse_surfels(
    points: DataFrame, voxel: float = SURFEL_VOXEL_M, order: Sequence[str] = ("stamp_ns", "seq"), key: Sequence[str] = ("session_id",),
    normals: bool = True, limit: int | None = None,
) -> DataFrame:
    """One surfel per cell from its points in order: capped running mean of position and colour, count, confidence,
    radius, unit normal towards the observer (``ox, oy, oz`` of each point), last update.

    Position and colour have a closed form: rank and number of the point in its cell give its weight, and the weighted
    sums are plain aggregates.  Only the normal needs an ordered fold, because it is brought to unit length at each step.
    """
    voxel = max(0.01, voxel)
    finite = points.filter(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))).withColumns(voxel_columns(voxel))
    cell = [*key, *VOXEL]
    in_order = OrderedRows(finite, cell, list(order), limit)
    ranked = in_order.rank("_i").total("_n", F.lit(1).cast("bigint")).result()
    weighted = ranked.withColumn("_w", surfel_weights(F.col("_i"), F.col("_n")))
    # up to the cap the running mean is the plain mean, whose sum of whole colours is exact
    plain = F.count("*") <= FUSION_CAP + 1
    means = [F.when(plain, F.sum(c) / F.count("*")).otherwise(F.sum(F.col("_w") * F.col(c))).alias(c) for c in ("x", "y", "z", "r", "g", "b")]
    fused = weighted.groupBy(*cell).agg(
        *means,
        F.count("*").alias("observation_count"),
        F.max(F.when(F.col("_i") == F.col("_n"), F.col("stamp_ns"))).alias("updated_at"),
    )
    out = surfel_values(fused, voxel)
    if not normals:
        return out
    facing = [c.alias(f"in{a}") for a, c in zip("xyz", towards_observer())]
    return out.join(_blended_normals(ranked.select(*cell, *order, "_i", "_n", *facing), cell, list(order)), cell)


def surfel_values(fused: DataFrame, voxel: float) -> DataFrame:
    """Confidence and radius from the number of observations, and colours as whole numbers."""
    return fused.withColumns(
        {
            "confidence": F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.04) * (F.col("observation_count") - 1)),
            "radius": F.lit(voxel * 0.75),
            **{c: clamp(F.round(F.col(c)), 0, 255).cast("smallint") for c in "rgb"},
        }
    )


def towards_observer() -> list[Column]:
    delta = [F.col(f"o{c}") - F.col(c) for c in "xyz"]
    length = F.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2])
    usable = is_finite(length) & (length > F.lit(1e-6))
    return [F.when(usable, d / length).otherwise(F.lit(f)) for d, f in zip(delta, (0.0, 1.0, 0.0))]


def _blended_normals(incoming: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """Blended normal of each cell: a fold over all its observations in order, as a stream of rows.

    The state is the number of observations (up to the cap) and the unit normal so far; the past is never forgotten
    (what came before is weighed by 64 in 65 at least), so each step needs the one before.  A row leaves with the last
    observation of its cell (``_i`` is ``_n``).
    """
    schema = T.StructType([incoming.schema[c] for c in cell] + [T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz")])

    def blend(state, rows: pa.RecordBatch):
        n, x, y, z = state or (0, 0.0, 0.0, 0.0)
        for a, b, c in zip(*[rows.column(f"in{k}").to_pylist() for k in "xyz"]):
            x, y, z = x * n + a, y * n + b, z * n + c
            length = math.sqrt(x * x + y * y + z * z)
            x, y, z = (x / length, y / length, z / length) if math.isfinite(length) and length > 1e-6 else (0.0, 1.0, 0.0)
            n = min(n + 1, FUSION_CAP)
        last = rows.num_rows - 1
        if rows.column("_i")[last] != rows.column("_n")[last]:
            return (n, x, y, z), None
        made = [*rows.select(cell).slice(last).columns, *[pa.array([v]) for v in (x, y, z)]]
        return None, pa.RecordBatch.from_arrays(made, schema.names)

    return key_stream(incoming, cell, order, blend, schema)


def top_surfels(surfels: DataFrame, n: int) -> DataFrame:
    """Highest confidence, then newest; the cell settles ties."""
    return surfels.orderBy(F.col("confidence").desc(), F.col("updated_at").desc(), *VOXEL).limit(max(0, n))


def _first_n(surfels: DataFrame, key: Sequence[str], descending: Sequence[str], n: int, limit: int | None) -> DataFrame:
    """The first ``n`` per key in descending order; a key of any size is ranked block by block."""
    negative = {f"_neg{i}": -F.col(c) for i, c in enumerate(descending)}
    rows = OrderedRows(surfels.withColumns(negative), key, [*negative, *VOXEL], limit).rank("_rank").result()
    return rows.filter(F.col("_rank") <= n).drop("_rank", *negative)


def top_surfels_per(surfels: DataFrame, n: int, key: Sequence[str] = ("session_id",), limit: int | None = None) -> DataFrame:
    return _first_n(surfels, key, ["confidence", "updated_at"], n, limit)


def trim_surfels(surfels: DataFrame, maximum: int | None = None, key: Sequence[str] = ("session_id",), limit: int | None = None) -> DataFrame:
    """Keep the ``maximum`` most recently updated per session (None: all)."""
    if maximum is None:
        return surfels
    return _first_n(surfels, key, ["updated_at"], maximum, limit)


# --- artifacts ---------------------------------------------------------------------------------------------------------


def final_artifact(dense: DataFrame, cleaned: DataFrame, mesh_vertices: DataFrame, key: Sequence[str] = ("session_id",)) -> DataFrame:
    """Points of the first source that has any, per session: dense, then cleaned, then mesh vertices (white)."""
    def source(df: DataFrame, priority: int, name: str, white: bool = False) -> DataFrame:
        colour = [F.lit(255).cast("smallint").alias(c) if white else F.col(c).cast("smallint").alias(c) for c in "rgb"]
        return df.select(*key, "x", "y", "z", *colour, F.lit(priority).alias("_priority"), F.lit(name).alias("source"))

    rows = (
        source(dense, 0, "depth_anything_lidar_calibrated_full_resolution")
        .unionByName(source(cleaned, 1, "fused_depth_pointcloud"))
        .unionByName(source(mesh_vertices, 2, "overlay_mesh_vertices", True))
    )
    # one row per session and source that has points; joined back instead of a window over all points
    best = rows.groupBy(*key).agg(F.min("_priority").alias("_priority"))
    return rows.join(best, [*key, "_priority"], "left_semi").drop("_priority")


def terrain_points(pixels: DataFrame) -> DataFrame:
    """Raster cells (``row, col, value`` with the tile's ``bounds, width, height``) at the middle of their ground area."""
    b = F.col("bounds")
    return pixels.filter(is_finite(F.col("value"))).withColumns(
        {
            "lon": b["west"] + (F.col("col") + F.lit(0.5)) / F.col("width") * (b["east"] - b["west"]),
            "lat": b["north"] - (F.col("row") + F.lit(0.5)) / F.col("height") * (b["north"] - b["south"]),
            "alt": F.col("value"),
        }
    )
