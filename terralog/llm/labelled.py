"""Folds by document id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def usable_labels(labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the rows that may be learnt from: label 0 or 1, an id, not held out; the largest of several labels."""
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out)
    return clean.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, label) of at most ``per_class`` rows of each label 0 and 1 that are not held out.

    The sample is that of the smallest hashes of the ids, so it is the same for any partitioning.  Each class is taken
    by a top-k, which keeps k rows per task; the ids (2 * per_class at most) are sent to all tasks to filter documents.
    Rows with a null id or label, and labels other than 0 and 1, are not used; of labels that repeat an id the largest
    counts, and of documents that repeat an id one row does.
    """
    one = usable_labels(labels, label, held_out, id_col)
    taken = [one.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    joined = plain.join(F.broadcast(taken[0].unionByName(taken[1])), "id")
    return joined.groupBy("id").agg(F.min("body").alias("body"), F.first("label").alias("label"))
