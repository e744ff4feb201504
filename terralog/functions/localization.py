"""Satellite fixes and indoor-localisation quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralog.functions.numeric import clamp, finite_or, is_finite

VALIDITY_FIELDS = (
    "horizontal_accuracy", "vertical_accuracy", "speed", "speed_accuracy", "course", "course_accuracy",
)


def navsat_fix(lat: Column, lon: Column, alt: Column, hacc: Column, vacc: Column) -> Column:
    """Fix message fields: status, service, position and covariance."""
    h, v = finite_or(hacc, -1.0), finite_or(vacc, -1.0)
    has_fix = is_finite(lat) & is_finite(lon) & (h >= 0)
    h_var = F.when(h >= 0, h * h).otherwise(F.lit(0.0))
    v_var = F.when(v >= 0, v * v).otherwise(h_var)
    zero = F.lit(0.0)
    return F.struct(
        has_fix.alias("has_fix"),
        F.when(has_fix, 0).otherwise(-1).alias("status"),
        F.when(has_fix, 1).otherwise(0).alias("service"),
        finite_or(lat, 0.0).alias("latitude"),
        finite_or(lon, 0.0).alias("longitude"),
        finite_or(alt, 0.0).alias("altitude"),
        F.array(h_var, zero, zero, zero, h_var, zero, zero, zero, v_var).alias("position_covariance"),
        F.when((h >= 0) & (v >= 0), 2).when(h >= 0, 1).otherwise(0).alias("position_covariance_type"),
    )


def fix_validity(lat: Column, lon: Column, alt: Column, **readings: Column) -> Column:
    """Eight flags; the six readings count when finite and not negative."""
    def valid(name: str) -> Column:
        value = readings.get(name, F.lit(None))
        return (is_finite(value) & F.coalesce(value.cast("double") >= 0, F.lit(False))).alias(name)

    return F.struct(
        (is_finite(lat) & is_finite(lon)).alias("coordinate"), is_finite(alt).alias("altitude"), *[valid(n) for n in VALIDITY_FIELDS]
    )


def accuracy_score(value: Column, excellent: float, unusable: float) -> Column:
    ramp = F.lit(1.0) - (value - F.lit(excellent)) / F.lit(unusable - excellent)
    return (
        F.when(~is_finite(value) | (value < 0), F.lit(0.0))
        .when(value <= F.lit(excellent), F.lit(1.0))
        .when(value >= F.lit(unusable), F.lit(0.0))
        .otherwise(ramp)
    )


def freshness_score(age: Column) -> Column:
    return F.when(age <= 1, F.lit(1.0)).when(age >= 10, F.lit(0.0)).otherwise(F.lit(1.0) - (age - F.lit(1.0)) / F.lit(9.0))


def source_score(simulated: Column, accessory: Column) -> Column:
    return F.when(simulated, F.lit(0.2)).when(accessory, F.lit(0.8)).otherwise(F.lit(1.0))


def indoor_quality(hacc: Column, floor: Column, heading_acc: Column, age: Column, source: Column) -> Column:
    heading = F.when(heading_acc.isNull(), F.lit(0.25)).otherwise(accuracy_score(heading_acc, 8.0, 60.0))
    return clamp(
        accuracy_score(hacc, 3.0, 25.0) * F.lit(0.38)
        + F.when(floor.isNull(), F.lit(0.35)).otherwise(F.lit(1.0)) * F.lit(0.24)
        + heading * F.lit(0.18)
        + freshness_score(age) * F.lit(0.10)
        + source * F.lit(0.10),
        0.0,
        1.0,
    )


def global_quality(lat: Column, lon: Column, hacc: Column, vacc: Column, heading_acc: Column, source: Column) -> Column:
    heading = F.when(heading_acc.isNull(), F.lit(0.3)).otherwise(accuracy_score(heading_acc, 10.0, 90.0))
    coordinate = F.when(is_finite(lat) & is_finite(lon), F.lit(1.0)).otherwise(F.lit(0.0))
    return clamp(
        accuracy_score(hacc, 5.0, 60.0) * F.lit(0.34)
        + accuracy_score(vacc, 8.0, 80.0) * F.lit(0.20)
        + heading * F.lit(0.16)
        + coordinate * F.lit(0.20)
        + source * F.lit(0.10),
        0.0,
        1.0,
    )


def quality_label(score: Column) -> Column:
    known = is_finite(score)
    return (
        F.when(known & (score >= 0.8), "high").when(known & (score >= 0.5), "medium").when(known & (score >= 0.25), "low").otherwise("unusable")
    )
