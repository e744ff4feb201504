"""What several operators here share: plain inputs, row numbers over ordered tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralog.session import freeze, scratch_path

#: White space of the text contracts: space and the controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body): the two columns that an operator reads, under own names, so that no other column can clash.

    A null text becomes the empty text.
    """
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))


def batches(parts: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes``, so that Python objects of few texts exist at a time."""
    for part in parts:
        if not part.num_rows:
            continue
        step = max(1, int(part.num_rows * most_bytes / max(1, part.nbytes)))
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


def freeze_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its place, for ``discard`` when nothing reads it any more."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``freeze_at``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: Sequence[Column], position: str) -> DataFrame:
    """Adds the row's position, from 0, in the global ``order``; the rows are written once in that order.

    Rows are range-partitioned and sorted, so no task gets more than its range.  Spark's own row id holds the
    partition and the place in it; only the row counts of the partitions are summed up, on one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = freeze(ranged.withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright("_mono", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition of the table
    place = F.col("_mono").bitwiseAND((1 << 33) - 1)
    return joined.withColumn(position, (F.col("_base") + place).cast("bigint")).drop("_mono", "_part", "_base")


def _all_stars(links: DataFrame) -> bool:
    """Whether every node of ``links`` (a, b; distinct) is an ``a`` once and no ``b``, or a ``b`` only."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of_node.agg(F.bool_or(F.expr("up + down > 1"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that can be reached.

    Alternating stars: in turn every node hands its larger, then its smaller neighbours to the smallest one.  Each step
    is a pre-aggregated minimum per node and an equi join; the links never grow in number, and the rounds grow with the
    logarithm of the longest chain.  Each round is a table in the shared folder, so lineage stays short.  The links keep
    what is connected and lead to smaller nodes, so they are done when they are stars, which steps no longer change.
    """
    now = freeze(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = large.filter(F.col("a") != F.col("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        held = large.join(low, "a")
        small = held.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = freeze(small.filter(F.col("a") != F.col("b")).distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
