"""Finite-safe numbers (Spark treats NaN as larger than any value, so every test is explicit)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def is_finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INFINITY))


def finite_or(value: Column, fallback: float) -> Column:
    return F.when(is_finite(value), value).otherwise(F.lit(fallback))


def sanitize(df: DataFrame, fallbacks: Mapping[str, float]) -> DataFrame:
    """Replace non-finite values column by column; null counts as non-finite."""
    return df.withColumns({name: finite_or(F.col(name), value) for name, value in fallbacks.items()})


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def quantize(value: Column, scale: float = 1e4) -> Column:
    """Scaled integer form: compares equal between engines where a rounded double may not."""
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def whole_div(value: Column, by: int | Column) -> Column:
    """Integer division of whole numbers; stamps in nanoseconds are too large to divide as doubles."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def fixed(value: Column, digits: int = 6) -> Column:
    """A double with ``digits`` decimals, six at most, as C prints it: its exact value is rounded, exact ties go to the even
    digit.  ``format_string`` rounds the shortest decimal that names the double, half up; it still writes what is not
    finite or has no fraction left (2^53 and more).
    """
    value, scale, cut = value.cast("double"), 10**digits, F.lit(float(1 << 26))

    def rounded(whole: Column, count: Column) -> Column:
        text = whole_div(count, scale) + whole, F.lpad((count % scale).cast("string"), digits, "0")
        return F.concat(F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise(""), text[0].cast("string"), F.lit("."), text[1])

    def digits_of(part: Column, whole: Column) -> Column:
        # both halves of the fraction are short enough to be multiplied without rounding
        high = F.floor(part * cut) / cut
        return let(
            F.struct((high * F.lit(float(scale))).alias("a"), ((part - high) * F.lit(float(scale))).alias("b")),
            lambda s: let(
                F.struct(F.floor(s["a"]).alias("n"), (s["a"] - F.floor(s["a"]) + s["b"]).alias("r")),
                lambda s: let(
                    F.struct((s["n"] + F.floor(s["r"])).alias("n"), (s["r"] - F.floor(s["r"])).alias("r")),
                    lambda s: rounded(whole, s["n"] + F.when((s["r"] > 0.5) | ((s["r"] == 0.5) & (s["n"] % 2 == 1)), 1).otherwise(0)),
                ),
            ),
        )

    size = F.abs(value)
    exact = F.when(size < F.lit(float(1 << 53)), let(F.floor(size), lambda whole: let(size - whole, lambda part: digits_of(part, whole))))
    return F.coalesce(exact, F.format_string(f"%.{digits}f", value))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A plain column would be repeated in every filter that the optimizer moves below it; an exploded one-element array is
    a step that filters on the column stay above.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
