"""Joins: as-of, look-ups on computed keys, region membership, semi and anti."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.tiles import normal_longitude, region_contains
from terralog.operators.ordered import BUCKET_NS, OrderedRows


#: Sides of cells in degrees, cells that a box may be wide and high, and shares that the fixes of a cell are dealt to.
CELL_SIZES = (1 / 128, 1 / 8, 2.0, 32.0)
CELL_SPAN, CELL_SALTS = 16, 16


def with_topic(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic name and type per message; topic ids repeat between chunks, so the chunk is part of the key."""
    return messages.join(topics, ["chunk", "topic_id"])


def asof_rows(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, right_cols: Sequence[str], *,
    left_tie: Sequence[str] = (), right_tie: Sequence[str] = (), limit: int | None = None, width: int | None = BUCKET_NS,
) -> OrderedRows:
    """Both sides in one stream ordered by stamp, right before left on equal stamps, with the last right row carried
    along as ``_match``.  Left rows have ``_side`` 1 and their columns in ``_left``."""
    on = list(on)
    left_cols = [c for c in left.columns if c not in on]
    payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c).alias(c) for c in right_cols])
    ties = max(len(left_tie), len(right_tie))

    def tie_columns(names: Sequence[str]) -> list[Column]:
        filled = [F.col(n).cast("bigint") for n in names] + [F.lit(0).cast("bigint")] * (ties - len(names))
        return [c.alias(f"_tie{i}") for i, c in enumerate(filled)]

    keys = [F.col(k) for k in on]
    lefts = left.select(
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), *tie_columns(left_tie),
        F.struct(*left_cols).alias("_left"), F.lit(None).alias("_right"),
    )
    rights = right.select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), *tie_columns(right_tie),
        F.lit(None).alias("_left"), payload.alias("_right"),
    )
    order = ["_ts", "_side", *[f"_tie{i}" for i in range(ties)]]
    return OrderedRows(lefts.unionByName(rights), on, order, limit, width=width).carry("_match", F.col("_right"))


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, right_cols: Sequence[str], *,
    left_tie: Sequence[str] = (), right_tie: Sequence[str] = (), tolerance=None, limit: int | None = None, width: int | None = BUCKET_NS,
) -> DataFrame:
    """For each left row the latest right row whose stamp is not after it (within ``tolerance``); left rows all stay.

    No range-join blow-up: rows are shuffled once by (key, stretch of ``width`` stamps), and the last right row of each
    stretch is carried over the stretches of its key, so a key that holds most rows is spread by time.  ``*_tie`` columns
    make the order total.
    """
    on = list(on)
    rows = asof_rows(left, right, on, left_ts, right_ts, right_cols, left_tie=left_tie, right_tie=right_tie, limit=limit, width=width).result()
    match = F.col("_match")
    if tolerance is not None:
        match = F.when(F.col("_ts") - F.col("_match._rts") <= F.lit(tolerance), match)
    left_cols = [c for c in left.columns if c not in on]
    return (
        rows.filter(F.col("_side") == 1)
        .withColumn("_match", match)
        .select(*on, *[F.col(f"_left.{c}").alias(c) for c in left_cols], *[F.col(f"_match.{c}").alias(c) for c in right_cols])
    )


def asof_topics(
    messages: DataFrame, left: str, right: str, right_cols: Sequence[str], key: Sequence[str] = ("session_id",), stamp: str = "stamp_ns", tie: Sequence[str] = ("row_id",),
    tolerance=None, width: int | None = BUCKET_NS, block: str | None = None,
) -> DataFrame:
    """As-of join of two topics of one message table: each message of ``left`` with the latest one of ``right`` not after it.

    The table is read once, and with ``block`` (``bag.land_ordered``) its rows are not shuffled.
    """
    both = messages.filter(F.col("topic").isin(left, right)).withColumn("_side", (F.col("topic") == left).cast("int"))
    found = F.struct(F.col(stamp).alias("_rts"), *right_cols)
    rows = OrderedRows(both, key, [stamp, "_side", *tie], width=width, block=block).carry("_match", F.when(F.col("_side") == 0, found)).result()
    match = F.col("_match")
    if tolerance is not None:
        match = F.when(F.col(stamp) - match["_rts"] <= F.lit(tolerance), match)
    lefts = rows.filter(F.col("_side") == 1).withColumn("_match", match)
    return lefts.select(*messages.columns, *[F.col(f"_match.{c}").alias(f"right_{c}") for c in right_cols])


def pair_stamp(left: DataFrame, right: DataFrame, key: Sequence[str] = ("session_id", "stamp_ns")) -> DataFrame:
    """Messages of two topics that carry the identical header stamp."""
    return left.join(right, list(key))


def sample_index(position: Column, from_size: Column, to_size: Column) -> Column:
    """Index in the other grid at the same normalised position: truncated, then clamped."""
    top = F.greatest(to_size - 1, F.lit(1))
    scaled = (position / F.greatest(from_size - 1, F.lit(1)) * top).cast("int")
    return F.greatest(F.lit(0), F.least(to_size - 1, scaled))


def nearest_sample(
    a: DataFrame, b: DataFrame, a_xy: tuple[str, str], b_xy: tuple[str, str], a_size: tuple[Column, Column],
    b_size: tuple[Column, Column], key: str = "frame",
) -> DataFrame:
    """Each cell of grid ``a`` with the cell of grid ``b`` at the same normalised position."""
    keyed = a.withColumns(
        {
            b_xy[0]: sample_index(F.col(a_xy[0]), a_size[0], b_size[0]),
            b_xy[1]: sample_index(F.col(a_xy[1]), a_size[1], b_size[1]),
        }
    )
    return keyed.join(b, [key, *b_xy])


def _cell_index(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("bigint")


def region_cells(regions: DataFrame, size: float) -> DataFrame:
    """The boxes whose cover is made of cells of ``size`` degrees, one row per cell that a box touches and salt.

    A box goes to the smallest cells of which it is at most 16 wide and high, so it touches 17 by 17 of them at most,
    whether it is a hundredth of a degree or the globe.
    """
    boxes = regions.select(*[F.col(c).alias(f"_r_{c}") for c in regions.columns])
    south, north = F.col("_r_south"), F.col("_r_north")
    west, east = normal_longitude(F.col("_r_west")), normal_longitude(F.col("_r_east"))
    extent = F.greatest(north - south, F.when(west <= east, east - west).otherwise(east - west + 360))
    fits, too_small = extent <= F.lit(CELL_SPAN * size), F.lit(False)
    smaller = [s for s in CELL_SIZES if s < size]
    if smaller:
        too_small = extent <= F.lit(CELL_SPAN * max(smaller))
    around = F.concat(F.sequence(_cell_index(west, size), _cell_index(F.lit(180.0), size)), F.sequence(_cell_index(F.lit(-180.0), size), _cell_index(east, size)))
    columns = F.when(west <= east, F.sequence(_cell_index(west, size), _cell_index(east, size))).otherwise(around)
    chosen = boxes.filter(fits & ~too_small)
    listed = chosen.withColumn("_r_row", F.explode(F.sequence(_cell_index(south, size), _cell_index(north, size)))).withColumn("_r_column", F.explode(columns))
    return listed.withColumn("_r_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CELL_SALTS - 1).cast("bigint"))))


def position_cells(fixes: DataFrame) -> DataFrame:
    """Adds ``_salt`` and, per cell size, the row and column of the fix: the keys that regions are met on.

    Fixes of one cell, a city's worth, are dealt over salts, and boxes are listed once per salt.
    """
    lon = normal_longitude(F.col("lon"))
    salted = fixes.withColumn("_salt", F.pmod(F.xxhash64(*fixes.columns), F.lit(CELL_SALTS)))
    return salted.withColumns({f"_{axis}{k}": _cell_index(degrees, size) for k, size in enumerate(CELL_SIZES) for axis, degrees in (("row", F.col("lat")), ("column", lon))})


def in_region(fixes: DataFrame, regions: DataFrame, how: str = "left_semi") -> DataFrame:
    """Fixes inside a region box (``inner``: with the box's columns, once per box that holds them).

    Boxes are covered by cells of a size that suits them and fixes are looked up in each size, so a table may mix boxes of
    any extent.  Every look-up is an equi join on cell and salt; the planner sends a list to all tasks where it is small
    in bytes.  Fixes without position are in no box.
    """
    placed = position_cells(fixes)
    helpers = [c for c in placed.columns if c not in fixes.columns]

    def met(size: float, k: int, position) -> Column:
        cell = (F.col("_r_salt") == position("_salt")) & (F.col("_r_row") == position(f"_row{k}")) & (F.col("_r_column") == position(f"_column{k}"))
        return cell & region_contains(position("lat"), position("lon"), F.col("_r_south"), F.col("_r_west"), F.col("_r_north"), F.col("_r_east"))

    if how == "left_semi":
        found = [region_cells(regions, size).where(met(size, k, lambda c: F.col(c).outer())).exists() for k, size in enumerate(CELL_SIZES)]
        return placed.where(reduce(lambda a, b: a | b, found)).drop(*helpers)
    parts = [placed.join(region_cells(regions, size), met(size, k, F.col), how) for k, size in enumerate(CELL_SIZES)]
    return reduce(DataFrame.unionByName, parts).drop(*helpers, "_r_row", "_r_column", "_r_salt")


TILE_KEY = ("provider", "layer", "date", "z", "x", "y")


def tile_hits(wanted: DataFrame, cached: DataFrame, key: Sequence[str] = TILE_KEY, newest: Sequence[str] | None = None) -> DataFrame:
    """Cache look-up: every wanted tile stays, with ``is_cached`` and the cached columns (null on a miss).

    Of several cached rows of a tile the last one by ``newest`` counts, by default by all its other columns.

    ``date`` is the text "static" where a layer has no date, so keys compare without nulls.  Many fixes ask for the
    same tile, so the cached side is unique per key and the wanted side is not deduplicated.
    """
    rest = [c for c in cached.columns if c not in key]
    order = F.struct(*[F.col(c) for c in [*(newest or ()), *rest]]) if rest else F.lit(0)
    last = cached.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*") if rest else cached.distinct()
    tiles = last.withColumn("is_cached", F.lit(True))
    joined = wanted.join(tiles, list(key), "left")
    return joined.withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))


def tile_misses(wanted: DataFrame, cached: DataFrame, key: Sequence[str] = TILE_KEY) -> DataFrame:
    """Distinct wanted tiles that the cache does not hold."""
    return wanted.select(*key).distinct().join(cached.select(*key), list(key), "left_anti")


def enabled_topics(topics: DataFrame, streams: DataFrame) -> DataFrame:
    """Implemented topics whose stream is enabled."""
    return topics.filter("is_implemented").join(streams.select("stream"), "stream", "left_semi")


def convertible(topics: DataFrame, known_types: DataFrame, on_unknown: str = "skip") -> DataFrame:
    """Topics of a known type.  ``on_unknown='fail'`` stops at an unknown type when the frame is run; no convertible
    topic at all is an error then too."""
    known = known_types.select("type").distinct().withColumn("_known", F.lit(True))
    marked = topics.join(known, "type", "left")
    if on_unknown == "fail":
        message = F.concat(F.lit("no schema for "), F.col("topic"), F.lit(" "), F.col("type"))
        checked = F.when(F.col("_known").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return marked.filter(checked).drop("_known")
    return marked.filter("_known").drop("_known")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or an error when it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def unpublished(new: DataFrame, published: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Rows whose key was not published before."""
    return new.join(published.select(key), key, "left_anti")


def radio_position(
    radio: DataFrame, pose: DataFrame, fix: DataFrame, tolerance_ns: int, key: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Local and geodetic position per radio sample, each with an availability flag; unset is 0."""
    local = asof_join(
        radio, pose, key, "stamp_ns", "stamp_ns", ["x", "y", "z"], left_tie=["seq"], right_tie=["seq"], tolerance=tolerance_ns
    )
    both = asof_join(
        local, fix, key, "stamp_ns", "stamp_ns", ["lat", "lon", "alt"], left_tie=["seq"], right_tie=["seq"], tolerance=tolerance_ns
    )
    out = both.withColumns(
        {"map_position_available": F.col("x").isNotNull(), "geodetic_position_available": F.col("lat").isNotNull()}
    )
    return out.fillna(0.0, ["x", "y", "z", "lat", "lon", "alt"])
