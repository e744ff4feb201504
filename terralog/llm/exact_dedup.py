"""Exact dedup by content sort."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.llm.common import BLANKS
from terralog.session import freeze

#: Bytes of the normalised text that lead the sort key; they bound what the sampled splitters hold.
HEAD_BYTES = 64

_BLANKS = re.compile(BLANKS)


def normalised(text):
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text, BLANKS, " ")


def _same(one: str, other: str) -> bool:
    return one == other or _BLANKS.sub(" ", one) == _BLANKS.sub(" ", other)


def _mark_runs(carried: int):
    """Compare every sorted row's whole text with the row before; number the runs of equal texts in the partition."""

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, last_sha, last_body = TaskContext.get().partitionId(), -1, None, None
        for rows in parts:
            opens, runs = [], []
            bodies = rows.column("_body")
            for k, sha in enumerate(rows.column("_sha").to_pylist()):
                opened = True
                if sha == last_sha:
                    body = bodies[k].as_py()
                    last_body = bodies[last_at].as_py() if last_body is None else last_body
                    opened = not _same(last_body, body)
                    last_body = body
                else:
                    last_body = None
                last_sha, last_at = sha, k
                run += opened
                opens.append(opened)
                runs.append(run)
            if rows.num_rows and last_body is None:
                last_body = bodies[rows.num_rows - 1].as_py()
            kept = [rows.column(k) for k in range(carried)] + [rows.column("_id"), rows.column("_sha")]
            names = rows.schema.names[:carried] + ["_id", "_sha", "_part", "_run", "_opens"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([part] * rows.num_rows, pa.int32()), pa.array(runs, pa.int64()), pa.array(opens, pa.bool_())], names
            )

    return mark


def content_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Documents in content order, written once, with the run of equal texts that each lies in.

    The key is the head of the normalised text, its SHA-256 and the id.  Spark samples splitters of this key, which is
    of bounded length, range-partitions by them and sorts each range externally.  The id is in the key, so a text with
    any number of copies is cut over several ranges.  Neighbours of equal digest are compared in full.

    Adds _id, _sha, _part, _run (number in the range) and _opens (first row of its run) to the ``carry`` columns.
    """
    norm = normalised(F.coalesce(F.col(text_col), F.lit("")))
    cols = [F.col(c).alias(f"_c_{c}") for c in carry]
    keyed = docs.select(
        *cols, F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_body"),
        F.substring(norm.cast("binary"), 1, HEAD_BYTES).alias("_head"), F.unhex(F.sha2(norm, 256)).alias("_sha"),
    )
    order = [F.col("_head"), F.col("_sha"), F.col("_id").asc_nulls_last()]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    own = [T.StructField("_id", T.LongType()), T.StructField("_sha", T.BinaryType()), T.StructField("_part", T.IntegerType()),
           T.StructField("_run", T.LongType()), T.StructField("_opens", T.BooleanType())]
    schema = T.StructType([keyed.schema[f"_c_{c}"] for c in carry] + own)
    return freeze(ranged.mapInArrow(_mark_runs(len(carry)), schema))


def _runs(marked: DataFrame) -> DataFrame:
    return marked.groupBy("_part", "_run").agg(F.first("_sha").alias("_sha"), F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after each run of white space became one space; a null text is empty.  The smallest
    id of equal texts stays; a null id counts as larger than any.  Of rows that repeat both id and text one is kept.
    An empty table gives no rows; other columns are not read.

    A run lies in one range and is bounded by it; runs of one text in neighbouring ranges are joined by their digest,
    at most one row per range.
    """
    marked = content_runs(docs, id_col, text_col)
    runs = _runs(marked)
    whole = runs.groupBy("_sha").agg(
        F.min("_low").alias("keep_id"), F.sum("_rows").cast("bigint").alias("group_size"), F.min("_part").alias("_first")
    )
    told = runs.select("_part", "_run", "_sha").join(whole, "_sha").drop("_sha")
    return marked.join(told, ["_part", "_run"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_opens") & (F.col("_part") == F.col("_first"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns and in content order.

    The columns travel with the sort.  A row stays if it opens its run, unless the run goes on from the range before.
    """
    marked = content_runs(docs, id_col, text_col, docs.columns)
    edges = _runs(marked).groupBy("_part").agg(
        F.min_by("_sha", "_run").alias("_top"), F.max_by("_sha", "_run").alias("_end")
    )
    before = F.lag("_end").over(Window.orderBy("_part"))  # one row per range of the sort
    goes_on = edges.withColumn("_goes_on", F.col("_top") == before).filter("_goes_on").select("_part", "_goes_on")
    opened = marked.filter("_opens").join(F.broadcast(goes_on), "_part", "left")
    kept = opened.filter(~((F.col("_run") == 0) & F.coalesce(F.col("_goes_on"), F.lit(False))))
    return kept.select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])
