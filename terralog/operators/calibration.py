"""Depth calibration against sparse range samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.numeric import is_finite
from terralog.operators.ordered import BUCKET_NS, OrderedRows, fold_rows

STEP = 4
MIN_SAMPLES = 50
MIN_DENOMINATOR = 1e-6


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == 0, F.lit(0.20)).when(confidence == 1, F.lit(0.65)).otherwise(F.lit(1.0))


def sample_weight(depth: Column, confidence: Column) -> Column:
    sigma = F.greatest(F.lit(0.015), F.lit(0.012) + F.lit(0.004) * depth * depth)
    return confidence_weight(confidence) / (sigma * sigma)


def _samples(pairs: DataFrame) -> DataFrame:
    d, r = F.col("depth"), F.col("relative")
    on_grid = (F.col("lx") % STEP == 0) & (F.col("ly") % STEP == 0)
    return pairs.filter(on_grid & is_finite(d) & (d > 0.2) & (d < 5.0) & is_finite(r) & (r > 0))


def _solve(sums: DataFrame, key: Sequence[str], finite: bool) -> DataFrame:
    c = F.col
    denominator = c("_w") * c("_xx") - c("_x") * c("_x")
    solvable = (c("samples") > MIN_SAMPLES) & (F.abs(denominator) > MIN_DENOMINATOR)
    out = sums.withColumns(
        {
            "scale": F.when(solvable, (c("_w") * c("_xy") - c("_x") * c("_y")) / denominator),
            "offset": F.when(solvable, (c("_y") * c("_xx") - c("_x") * c("_xy")) / denominator),
        }
    ).select(*key, "samples", "scale", "offset")
    if finite:
        good = is_finite(c("scale")) & is_finite(c("offset"))
        out = out.withColumns({"scale": F.when(good, c("scale")), "offset": F.when(good, c("offset"))})
    return out


def fit_calibration(pairs: DataFrame, key: Sequence[str] = ("frame",)) -> DataFrame:
    """Weighted least squares metric = scale * relative + offset per frame; null where the gates are not met.

    ``pairs`` are range cells (``lx, ly, depth, confidence``) with the relative depth at the same place (C5).  One
    aggregation of five sums, combined before the shuffle.
    """
    samples = _samples(pairs).withColumn("_weight", sample_weight(F.col("depth"), F.col("confidence")))
    w, x, y = F.col("_weight"), F.col("relative"), F.col("depth")
    sums = samples.groupBy(*key).agg(
        F.count("*").alias("samples"), F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"),
        F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"),
    )
    return _solve(sums, key, True)


def fit_affine(pairs: DataFrame, key: Sequence[str] = ("frame",)) -> DataFrame:
    """Unweighted form with the same gates."""
    x, y = F.col("relative"), F.col("depth")
    sums = _samples(pairs).groupBy(*key).agg(
        F.count("*").alias("samples"), F.count("*").cast("double").alias("_w"), F.sum(x).alias("_x"), F.sum(y).alias("_y"),
        F.sum(x * x).alias("_xx"), F.sum(x * y).alias("_xy"),
    )
    return _solve(sums, key, False)


# --- reuse -------------------------------------------------------------------------------------------------------------

_SIZES = ("relative_w", "relative_h", "lidar_w", "lidar_h", "confidence_w", "confidence_h")


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    la, lb = float(np.linalg.norm(a)), float(np.linalg.norm(b))
    if not (la > 1e-5 and lb > 1e-5):
        return float("inf")
    return float(np.arccos(min(1.0, max(-1.0, float(np.dot(a / la, b / lb))))))


def reuse_calibration(
    frames: DataFrame, key: Sequence[str] = ("session_id",), max_age: float = 1.25, max_move: float = 0.20, max_turn: float = 0.25,
    width: int | None = BUCKET_NS,
) -> DataFrame:
    """Which calibration each frame uses: the last computed one while it is fresh, of the same sizes, and the camera has
    hardly moved or turned; else the frame's own fit.  A failed fit keeps the old entry and yields null.

    ``frames`` is one row per frame with its own fit (``scale, offset``) and transform ``m``, so the pixels were already
    reduced.  A frame that comes later than ``max_age`` after the one before it can reuse nothing, so the fold is cut
    there, and runs of close frames are folded apart, each as a stream of rows.
    """
    identity = [*key, "stamp_ns", "frame"]
    schema = T.StructType(
        [frames.schema[c] for c in identity]
        + [T.StructField("scale", T.DoubleType()), T.StructField("offset", T.DoubleType()), T.StructField("reused", T.BooleanType())]
    )

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list | None, pd.DataFrame]:
        scales, offsets, reused = [], [], []
        for row in rows.itertuples(index=False):
            m = np.asarray(row.m, dtype=float)
            place, up, forward = m[[3, 7, 11]], m[[1, 5, 9]], -m[[2, 6, 10]]
            seconds = row.stamp_ns / 1e9
            sizes = [None if pd.isna(v) else int(v) for v in (getattr(row, s) for s in _SIZES)]
            keep = False
            if state is not None:
                old_ns, old_scale, old_offset, old_place, old_up, old_forward, old_sizes = state
                age = (int(row.stamp_ns) - old_ns) / 1e9
                keep = (
                    0 <= age <= max_age
                    and sizes == old_sizes
                    and float(np.linalg.norm(place - np.array(old_place))) <= max_move
                    and max(_angle(forward, np.array(old_forward)), _angle(up, np.array(old_up))) <= max_turn
                )
            if keep:
                scales.append(state[1]), offsets.append(state[2]), reused.append(True)
                continue
            reused.append(False)
            if pd.isna(row.scale) or pd.isna(row.offset):
                scales.append(None), offsets.append(None)
                continue
            state = [int(row.stamp_ns), float(row.scale), float(row.offset), place.tolist(), up.tolist(), forward.tolist(), sizes]
            scales.append(state[1]), offsets.append(state[2])
        out = rows[identity].assign(
            scale=pd.array(scales, dtype="Float64"), offset=pd.array(offsets, dtype="Float64"), reused=reused
        )
        return state, out

    # a frame that comes later than max_age after the one before it starts a run of its own
    order = ["stamp_ns", "frame"]
    gaps = OrderedRows(frames, key, order, width=width).previous("_b", "stamp_ns").result()
    apart = ((F.col("stamp_ns") - F.col("_b.stamp_ns")) / F.lit(1e9) > max_age).cast("int")
    marked = gaps.withColumn("_apart", F.coalesce(apart, F.lit(0))).drop("_b")
    runs = OrderedRows(marked, key, order, width=width).cumulative("_run", F.col("_apart")).result()
    return fold_rows(runs.drop("_apart"), [*key, "_run"], order, step, schema)
