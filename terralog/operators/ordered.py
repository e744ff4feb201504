"""Order-dependent work per key that does not rely on keys being small; nothing runs before the action.

``OrderedRows`` adds look-backs, look-aheads, running sums and ranks.  With a bucket ``width`` the rows of a key are dealt
over buckets of their first order column (stretches of time, say): windows run inside a bucket, one row per bucket is
carried over the buckets of the key, and both are joined on (key, bucket), all in one lazy plan.  ``key_stream`` runs a
state machine over each key's rows: they are shuffled by key, sorted in their partition (Spark spills), and pass through
Python batch by batch, so a key of any size needs the memory of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terralog.session import freeze, hot_rows

BLOCK, KEY = "_blk", "_key"
BUCKET_NS = 600_000_000_000  # ten minutes: some 40 000 rows at the rate of a recorded session
BUCKET_ROWS = 1 << 16  # row numbers, where these are the order


def join_same(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that treats null keys as equal and keeps the left names."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def in_sequence(df: DataFrame, name: str = "position") -> DataFrame:
    """The rows with their place, from 1, in the order that the frame has.  They are written once in that order; only the
    row counts of its partitions are summed up, on one task."""
    rows = freeze(df.withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright("_mono", 33)
    counts = rows.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per partition
    return placed.withColumn(name, F.col("_base") + F.col("_mono").bitwiseAND((1 << 33) - 1) + 1).drop("_mono", "_part", "_base")


class OrderedRows:
    """Rows in order per key; adds columns that look back (or ahead) along that order.

    ``order`` must be a total order within the key, so that the result does not depend on partitioning.  ``width`` is a
    stretch of the first order column, a whole number (nanoseconds, where it is a time); rows of a key spread over as many buckets as it spans, and each
    bucket should hold what one task can sort.  Without it a key is one plain window, which spills but sorts in one task.

    Where stamps say nothing about how many rows there are, ``limit`` (or the session's ``terralog.hotKeyRows``) states how
    many rows of one key a task may hold instead: rows are counted, range-partitioned on (key, order) and written once
    to the shared folder when the plan is made.  ``bound``, a proven largest number of rows per key, spares that.
    ``block`` names a column that holds the bucket already, as in a table that is landed by (key, bucket): windows and
    joins are then on the columns themselves, which must not be null, and rows of such a table are not shuffled again.
    All give the same rows.
    """

    def __init__(
        self, df: DataFrame, key: Sequence[str], order: Sequence[str], limit: int | None = None, bound: int | None = None, width: int | None = None,
        block: str | None = None,
    ):
        self.key, self.order = list(key), list(order)
        limit = limit or hot_rows(df.sparkSession)
        ranged = block is None and limit is not None and not (bound is not None and bound <= limit)
        self.hot = ranged or width is not None or block is not None
        self.over, self.block = (self.key, block) if block else ([KEY], BLOCK)
        self.blocks = [*self.over, self.block] if self.hot else self.key
        if block is not None:
            self.df = df
            return
        if ranged:
            parts = df.repartitionByRange(max(2, -(-df.count() // limit)), *self.key, *self.order)
            df = freeze(parts.withColumn(BLOCK, F.spark_partition_id().cast("bigint")))
        elif width is not None:
            first, kind = F.col(self.order[0]), df.schema[self.order[0]].dataType
            at = F.unix_micros(first.cast("timestamp")) * 1000 if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else first.cast("bigint")
            df = df.withColumn(BLOCK, F.coalesce(at - F.pmod(at, F.lit(width)), F.lit(-(1 << 63)).cast("bigint")))
        if self.hot:
            # one column that is never null, so that windows and joins on it share a partitioning
            df = df.withColumn(KEY, F.struct(*self.key) if self.key else F.struct(F.lit(0).alias("all")))
        self.df = df

    def _window(self, reverse: bool, stop: int):
        cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.blocks).orderBy(*cols).rowsBetween(Window.unboundedPreceding, stop)

    def _block_window(self, reverse: bool):
        col = F.col(self.block).desc() if reverse else F.col(self.block).asc()
        return Window.partitionBy(*self.over).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)

    def _with(self, name: str, local: Column, summary: Column, over_blocks: Column, combine: Callable[[Column, Column], Column]) -> OrderedRows:
        """A column inside blocks, a value per block carried over blocks, and both combined."""
        per_block = self.df.groupBy(*self.blocks).agg(summary.alias("_value"))
        carried = per_block.select(*self.blocks, over_blocks.alias("_carried"))
        joined = self.df.withColumn(name, local).join(carried, self.blocks, "left")
        self.df = joined.withColumn(name, combine(F.col(name), F.col("_carried"))).drop("_carried")
        return self

    def carry(self, name: str, value: Column, *, reverse: bool = False, inclusive: bool = True) -> OrderedRows:
        """Last non-null value up to the row (``reverse``: first one from the row on)."""
        local = F.last(value, ignorenulls=True).over(self._window(reverse, 0 if inclusive else -1))
        if not self.hot:
            self.df = self.df.withColumn(name, local)
            return self
        pick = F.min_by if reverse else F.max_by
        summary = pick(value, F.when(value.isNotNull(), F.struct(*self.order)))
        return self._with(name, local, summary, F.last("_value", ignorenulls=True).over(self._block_window(reverse)), F.coalesce)

    def first_seen(self, name: str, value: Column) -> OrderedRows:
        """First non-null value of the key, on the row that has it and on all rows after."""
        local = F.first(value, ignorenulls=True).over(self._window(False, 0))
        if not self.hot:
            self.df = self.df.withColumn(name, local)
            return self
        summary = F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        return self._with(name, local, summary, F.first("_value", ignorenulls=True).over(self._block_window(False)), lambda own, before: F.coalesce(before, own))

    def previous(self, name: str, *cols: str) -> OrderedRows:
        """The row before, as a struct of ``cols``; null on the first row."""
        return self.carry(name, F.struct(*cols), inclusive=False)

    def cumulative(self, name: str, value: Column) -> OrderedRows:
        """Running sum up to and including the row."""
        local = F.sum(value).over(self._window(False, 0))
        if not self.hot:
            self.df = self.df.withColumn(name, local)
            return self
        before = F.coalesce(F.sum("_value").over(self._block_window(False)), F.lit(0))
        return self._with(name, local, F.sum(value), before, lambda own, base: own + base)

    def total(self, name: str, value: Column) -> OrderedRows:
        """Sum over all rows of the key, on every row."""
        if not self.hot:
            self.df = self.df.withColumn(name, F.sum(value).over(Window.partitionBy(*self.key)))
            return self
        whole = F.sum("_value").over(Window.partitionBy(*self.over))
        return self._with(name, F.lit(None), F.sum(value), whole, lambda own, all_of: all_of)

    def rank(self, name: str) -> OrderedRows:
        """Position in the order, from 1; a plain row number, so that a filter on the first n drops rows before the shuffle."""
        if self.hot:
            return self.cumulative(name, F.lit(1).cast("bigint"))
        place = F.row_number().over(Window.partitionBy(*self.blocks).orderBy(*self.order))
        self.df = self.df.withColumn(name, place.cast("bigint"))
        return self

    def result(self) -> DataFrame:
        return self.df.drop(BLOCK, KEY)


def ranked_values(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Each distinct ``value``, a double that is not null, per key, with ``n`` rows that have it, ``upto`` that have it or a
    smaller one and ``all`` of the key.  What equals is counted before the shuffle; the values of a key are dealt over stretches of
    a 64th of an octave, so no task holds a key.
    """
    v, at = F.col(value), F.least(F.log2(F.abs(value)) * 64, F.lit(1e5))
    stretch = F.when(F.isnan(v), 200_000).otherwise(F.coalesce(F.signum(v) * (F.floor(at) + 70_000), F.lit(0.0))).cast("bigint")
    counted = df.filter(v.isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n")).withColumn("_stretch", stretch)
    rows = OrderedRows(counted, key, ["_stretch", value], width=1)
    return rows.cumulative("upto", F.col("n")).total("all", F.col("n")).result().drop("_stretch")


def quantile_of(value: str, share: str) -> Column:
    """Over ``ranked_values``: the smallest value at or below which the decimal ``share`` of a key's rows lies."""
    return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(share).cast("decimal(9,8)")), F.col(value)))


# --- state machines over a key's rows ----------------------------------------------------------------------------------

Handle = Callable[[object, pa.RecordBatch], tuple[object, pa.RecordBatch | None]]


def runs(batch: pa.RecordBatch, key: Sequence[str]) -> list[int]:
    """Where a new key begins in sorted rows, with 0 and the number of rows around."""
    new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for c in key:
        col = batch.column(c)
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]


def key_stream(df: DataFrame, key: Sequence[str], order: Sequence[str], handle: Handle, schema: T.StructType) -> DataFrame:
    """``handle(state, rows) -> (state, output rows)`` over each key's rows in order, a stretch at a time; None at the start.

    One shuffle by key and one sort in the partition, which spills.  State is handed from batch to batch, and the output
    leaves with its batch, so memory does not grow with a key.  What does is time: a key's rows pass one task, because
    each step needs the one before.
    """
    key, order = list(key), list(order)
    out_schema = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in parts:
            if not batch.num_rows:
                continue
            out, cuts = [], runs(batch, key)
            for low, high in zip(cuts, cuts[1:]):
                this = tuple(batch.column(c)[low].as_py() for c in key)
                if now is None or this != now:
                    now, state = this, None
                state, made = handle(state, batch.slice(low, high - low))
                if made is not None and made.num_rows:
                    out.append(made)
            if out:
                yield from pa.Table.from_batches(out).cast(out_schema).combine_chunks().to_batches()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def _jump_flags(start: np.ndarray, end: np.ndarray, width, strict: bool, last) -> tuple[np.ndarray, object]:
    """True for each row reached by jumping ``width`` on from the last true row (``last`` is its start; None: the first
    row is true), and the start of the last true row."""
    kept = np.zeros(len(start), dtype=bool)
    side = "right" if strict else "left"
    row = 0 if last is None else int(np.searchsorted(end, last + width, side=side))
    while row < len(start):
        kept[row], last = True, start[row]
        row = max(row + 1, int(np.searchsorted(end, last + width, side=side)))
    return kept, last


def mark_jumps(df: DataFrame, key: Sequence[str], order: Sequence[str], start: str, end: str, width, *, strict: bool, name: str) -> DataFrame:
    """Flag each row where ``end`` has moved ``width`` past ``start`` of the last flagged row.

    ``start`` and ``end`` must not fall along the order, and ``order`` must be total, as flags are joined back on it.
    This depends on the last *flagged* row, so it is a ``key_stream`` whose state is that row's start; only key, order,
    start and end reach Python.
    """
    identity = list(dict.fromkeys([*key, *order]))

    def walk(last, rows: pa.RecordBatch):
        flags, last = _jump_flags(rows.column(start).to_numpy(), rows.column(end).to_numpy(), width, strict, last)
        return last, rows.select(identity).filter(pa.array(flags))

    narrow = df.select(*dict.fromkeys([*identity, start, end]))
    chosen = key_stream(narrow, key, order, walk, T.StructType([df.schema[c] for c in identity]))
    marked = join_same(df, chosen.withColumn(name, F.lit(True)), identity)
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


Step = Callable[[list | None, pd.DataFrame], tuple[list | None, pd.DataFrame]]


def fold_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, schema: T.StructType) -> DataFrame:
    """``key_stream`` for steps on pandas rows: ``step(state, rows) -> (state, output rows)``."""
    out_schema = to_arrow_schema(schema)

    def handle(state, rows: pa.RecordBatch):
        state, out = step(state, rows.to_pandas())
        made = pa.Table.from_pandas(out[out_schema.names], out_schema, preserve_index=False).combine_chunks().to_batches()
        return state, made[0] if made else None

    return key_stream(df, key, order, handle, schema)
