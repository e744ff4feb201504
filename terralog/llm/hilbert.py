"""Shards along a Hilbert curve over quantised metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import numbered

#: Bits per dimension; the curve over three dimensions then has 2 ** 15 cells.
CELL_BITS = 5


def curve_index(point: Sequence[int], bits: int) -> int:
    """Place of a cell on the Hilbert curve: Gray-code undoing from the highest bit down, then the bits interleaved."""
    x, n, high = list(point), len(point), 1 << (bits - 1)
    level = high
    while level > 1:
        for k in range(n):
            if x[k] & level:
                x[0] ^= level - 1
            else:
                swap = (x[0] ^ x[k]) & (level - 1)
                x[0] ^= swap
                x[k] ^= swap
        level >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip, level = 0, high
    while level > 1:
        if x[n - 1] & level:
            flip ^= level - 1
        level >>= 1
    x = [v ^ flip for v in x]
    place = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | (v >> bit & 1)
    return place


def hashed_cell(value: Column, bits: int = CELL_BITS) -> Column:
    """Cell of a text value: its hash.  Null has a cell of its own kind, that of the empty hash."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def size_cell(size: Column, bits: int = CELL_BITS) -> Column:
    """Cell of a size: two steps for each doubling, the last cell open above."""
    step = F.floor(2 * F.log2(F.greatest(size, F.lit(1)).cast("double"))) - F.lit(8)
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), step)).cast("int")


def curve_table(spark, dims: int, bits: int = CELL_BITS) -> DataFrame:
    """(cell, curve) for all 2 ** (dims * bits) cells: its size depends on the parameters only."""
    mask = (1 << bits) - 1
    rows = [(c, curve_index([c >> (bits * k) & mask for k in reversed(range(dims))], bits)) for c in range(1 << (dims * bits))]
    return spark.createDataFrame(rows, "cell int, curve int")


def hilbert_order(docs: DataFrame, cells: Sequence[Column], bits: int = CELL_BITS) -> DataFrame:
    """Adds ``curve``: the place of each row's cell on the curve.  A broadcast join with the table of cells."""
    cell = sum((c * F.lit(1 << (bits * k)) for k, c in enumerate(reversed(list(cells)))), F.lit(0)).cast("int")
    table = curve_table(docs.sparkSession, len(cells), bits)
    return docs.withColumn("cell", cell).join(F.broadcast(table), "cell").drop("cell")


def hilbert_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 16), text_crc32, law ``rows``, shard, slot, grown_shard (null).

    Rows are ordered along the curve over language, source and size, then by id, and the order is cut into ``shards``
    runs whose row counts differ by one at most; ``slot`` is the place in the run.  A run covers few neighbouring cells,
    so a reader that filters on any of the dimensions skips most shards.

    A null text has no bytes; null metadata have a cell like any value.  Repeated rows are apart by their place in the
    order.  An empty table gives no rows.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(
        F.col(id_col).cast("bigint").alias("id"), (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body).cast("bigint").alias("text_crc32"),
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
    )
    placed = hilbert_order(plain, [hashed_cell(F.col("lang")), hashed_cell(F.col("source")), size_cell(F.col("size"))])
    order = [F.col("curve"), F.col("id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    ranked = numbered(placed.drop("lang", "source"), order, "_at")
    total = ranked.agg(F.count(F.lit(1)).alias("_all"))
    rows = ranked.join(F.broadcast(total))  # one row
    shard = F.expr(f"_at * {shards} div _all")
    first = F.expr(f"(shard * _all + {shards} - 1) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_at") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
