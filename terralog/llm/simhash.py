"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralog.llm.common import batches, components, texts_of
from terralog.session import freeze

SEED = 42
SHINGLE_WORDS = 3
BITS = 64

_WORDS = {c: " " for c in range(9, 14)} | {c: c + 32 for c in range(65, 91)}
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str, words: int = SHINGLE_WORDS) -> list[str]:
    """Word runs of the text in lower case (A-Z only), repeats included; a shorter text is one shingle."""
    found = [w for w in text.translate(_WORDS).split(" ") if w]
    if len(found) < words:
        return [" ".join(found)] if found else []
    return list(map(" ".join, zip(*(found[k:] for k in range(words)))))


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64 bits, as a signed integer: a bit is set if more than half of the shingles' hashes have it."""
    hashed = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)], dtype="<u8")
    if not len(hashed):
        return 0
    bytes_of = hashed.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(bytes_of[:, k], minlength=256) for k in range(8)]) @ _SET
    packed = np.packbits((2 * counts > len(hashed)).reshape(-1).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every whole text."""

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(parts):
            found = [fingerprint(t, words) for t in rows.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    return texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col).mapInArrow(mark, "id bigint, fp bigint")


def ball(half: int) -> list[int]:
    """All masks of at most ``half`` set bits out of 64, as signed integers."""
    masks, edge = {0}, {0}
    for _ in range(half):
        edge = {m | 1 << k for m in edge for k in range(BITS)}
        masks |= edge
    return sorted(m - (1 << BITS) if m >> (BITS - 1) else m for m in masks)


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` at most ``radius`` (even) bits apart; ``prints`` has each once.

    Every fingerprint emits the variants within half the radius.  Two that are linked meet in a variant, and all that
    meet in one are linked to each other, so a link to the smallest of them keeps what is connected without listing
    pairs.  A variant has as many fingerprints as there are masks at most (65 for radius 2), whatever the data.
    """
    masks = ball(radius // 2)
    variants = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("_mask")).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("_at"))
    met = variants.withColumn("_low", F.min("fp").over(Window.partitionBy("_at"))).filter(F.col("fp") != F.col("_low"))
    pairs = met.select(F.col("fp").alias("a"), F.col("_low").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Documents of equal fingerprint are one class, found by a pre-aggregated count, so copies never meet as pairs; the
    ball search runs over distinct fingerprints only.  A text without words (null, empty, blank) has fingerprint zero
    and is linked like any other.  A null id is kept as a row and is never the component's id unless all are null.
    """
    marked = freeze(fingerprints(docs, id_col, text_col, words))
    classes = freeze(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = freeze(components(ball_links(classes.select("fp"), radius)))
    of_class = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = of_class.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of_class.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group of ``near_groups``: the one with the smallest id; all columns are kept.

    Rows that share an id stay or go together, and rows without id stay where no other of their group has one.
    """
    groups = near_groups(docs.select(id_col, text_col), id_col, text_col, radius, words)
    stay = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stays")).distinct()
    return docs.join(stay, F.col(id_col).cast("bigint").eqNullSafe(F.col("_stays")), "left_semi")
