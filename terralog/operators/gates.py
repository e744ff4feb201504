"""Gates whose outcome depends on what was let through before."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.operators.ordered import join_same, key_stream, mark_jumps


def rate_gate(
    df: DataFrame, key: Sequence[str], interval, *, stamp: str = "stamp_ns", tie: Sequence[str] = ("row_id",), strict: bool = False
) -> DataFrame:
    """Rows at least ``interval`` (``strict``: more than it) after the last row that was kept."""
    marked = mark_jumps(df, key, [stamp, *tie], stamp, stamp, interval, strict=strict, name="_kept")
    return marked.filter("_kept").drop("_kept")


def assign_chunks(
    df: DataFrame, max_bytes: int, key: Sequence[str] = ("session_id",), order: Sequence[str] = ("row_id",), size: str = "bytes"
) -> DataFrame:
    """``chunk`` (from 0) per row: a new chunk starts where a non-empty one would grow over ``max_bytes``.

    The state that goes from batch to batch is the number of the open chunk and its bytes; only key, order and size
    reach Python, and chunk numbers are joined back on key and order, which names a row.  A null size counts as 0.
    """
    identity = list(dict.fromkeys([*key, *order]))

    def fill(state, rows: pa.RecordBatch):
        chunk, held = state or (0, None)
        ends = np.cumsum(pc.fill_null(rows.column("_size"), 0).to_numpy())
        before = ends - pc.fill_null(rows.column("_size"), 0).to_numpy()
        out, at = np.zeros(len(ends), dtype=np.int64), 0
        base = -held if held is not None else 0  # bytes of these rows that came before the open chunk
        while at < len(ends):
            # at least one row enters an empty chunk
            least = at if held is not None else at + 1
            stop = max(least, int(np.searchsorted(ends, base + max_bytes, side="right")))
            out[at:stop], at = chunk, stop
            if at < len(ends):
                chunk, held, base = chunk + 1, None, int(before[at])
            else:
                held = int(ends[-1]) - base
        made = rows.select(identity)
        return (chunk, held), pa.RecordBatch.from_arrays([*made.columns, pa.array(out)], [*identity, "chunk"])

    narrow = df.select(*identity, F.col(size).cast("bigint").alias("_size"))
    schema = T.StructType([df.schema[c] for c in identity] + [T.StructField("chunk", T.LongType())])
    return join_same(df, key_stream(narrow, key, order, fill, schema), identity)
