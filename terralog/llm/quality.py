"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.llm.common import batches
from terralog.llm.labelled import in_fold, labelled_sample, usable_labels

#: Bound of the fit, for tables of any size: labelled rows per class that vote.
ROWS_PER_CLASS = 3000
#: Hashed columns of word terms and of style terms, latent dimensions, voters, documents per block of products.
WORD_TERMS, STYLE_TERMS, LATENT, VOTERS, BLOCK = 1024, 1024, 48, 15, 512
#: Weight of style terms against words.
STYLE_WEIGHT = 3.0

_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_SHAPE = bytes(88 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def terms_of(text: str) -> dict[int, float]:
    """Counts by column: words, and style terms, which are the shape of a word (capitals, digits and signs, runs shortened),
    repetition of the word before, and the share of distinct words in eighths."""
    raw = text.encode()
    words = raw.lower().split()
    found: dict[int, float] = {}
    for word, n in Counter(words).items():
        at = zlib.crc32(word) % WORD_TERMS
        found[at] = found.get(at, 0.0) + n
    shapes: Counter = Counter()
    for shape, n in Counter(raw.translate(_SHAPE, _LOWER).split(b" ")).items():
        shapes[_RUN.sub(rb"\1", shape)] += n
    shapes[b"again"] = sum(map(eq, words, words[1:]))
    if words:
        shapes[b"distinct%d" % (8 * len(set(words)) // len(words))] = len(words)
    for shape, n in shapes.items():
        at = WORD_TERMS + zlib.crc32(shape) % STYLE_TERMS
        found[at] = found.get(at, 0.0) + n
    return found


def _shares(counts: np.ndarray) -> np.ndarray:
    """Rows of logarithmic term shares, in place of the counts: how a text is written, not how long it is."""
    counts *= 1000 / np.maximum(counts[:, WORD_TERMS:].sum(axis=1, keepdims=True), 1)
    return np.log1p(counts, out=counts)


def matrix_of(rows: list[dict[int, float]]) -> np.ndarray:
    """Term shares of texts by their terms."""
    out = np.zeros((len(rows), WORD_TERMS + STYLE_TERMS), np.float32)
    for k, found in enumerate(rows):
        if found:
            out[k, list(found)] = list(found.values())
    return _shares(out)


def matrix_of_table(rows: pa.Table) -> np.ndarray:
    """Term shares of the rows' lists ``columns`` and ``counts``, batch by batch and without Python objects."""
    out, at = np.zeros((rows.num_rows, WORD_TERMS + STYLE_TERMS), np.float32), 0
    for part in rows.select(["columns", "counts"]).to_batches():
        row = np.repeat(np.arange(at, at + part.num_rows), pc.list_value_length(part.column("columns")).to_numpy())
        out[row, part.column("columns").flatten().to_numpy()] = part.column("counts").flatten().to_numpy()
        at += part.num_rows
    return _shares(out)


@dataclass
class Space:
    """Latent space and the labelled vectors in it, all of bounded size."""

    weight: np.ndarray  # inverse document frequency by column
    basis: np.ndarray  # columns to latent dimensions
    voters: np.ndarray  # unit vectors of the labelled rows
    labels: np.ndarray
    shares: np.ndarray  # how many labelled rows of its class a voter stands for

    def vectors(self, matrix: np.ndarray) -> np.ndarray:
        found = (matrix * self.weight) @ self.basis
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def vote(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighted by cosine and by what a row stands for; products go
        block by block."""
        out = np.empty(len(texts))
        if not len(self.voters):
            out[:] = 0.5
            return out
        few = min(VOTERS, len(self.voters))
        for at in range(0, len(texts), BLOCK):
            near = self.vectors(matrix_of([terms_of(t) for t in texts[at : at + BLOCK]])) @ self.voters.T
            best = np.argpartition(-near, few - 1, axis=1)[:, :few]
            weight = np.maximum(np.take_along_axis(near, best, axis=1).astype(float), 0) ** 4 + 1e-9
            weight *= self.shares[best]
            out[at : at + BLOCK] = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit_space(matrix: np.ndarray, labels: list[int], class_sizes: dict[int, int]) -> Space:
    """Inverse document frequencies and the leading singular vectors of the sample, by subspace iteration.

    The matrix is weighted in place, and no second one of its size is made: the driver holds it once.
    """
    width = WORD_TERMS + STYLE_TERMS
    share = (1 + np.count_nonzero(matrix, axis=0)) / (1 + len(matrix))
    weight = (1 - np.log(share)).astype(np.float32)
    weight[WORD_TERMS:] *= STYLE_WEIGHT
    matrix *= weight
    basis = np.random.default_rng(11).standard_normal((width, LATENT)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    sampled = Counter(labels)
    shares = np.array([class_sizes[k] / sampled[k] for k in labels])
    space = Space(weight, basis.astype(np.float32), np.zeros((len(matrix), LATENT), np.float32), np.array(labels, float), shares)
    for at in range(0, len(matrix), BLOCK):
        space.voters[at : at + BLOCK] = space.vectors(matrix[at : at + BLOCK] / weight)
    return space


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, at_least: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` as they are, then _held_out, _score (0 to 1) and _predicted (1 from ``at_least`` on).

    At most ``ROWS_PER_CLASS`` labelled rows of each class span the latent space and vote; they go to every task.  The
    cosine of every document with every one of them is computed exactly; a vote counts for as many labelled rows as it
    stands for, so that the sample's balance does not shift the score.  Whole texts are read.

    A null or empty text is near to none and gets an even vote of equal weights among the rows first found; without
    labelled rows the score is 0.5.  Repeated rows score alike; a null id is not held out and never trained on.
    """
    held_out = in_fold(F.col(id_col), folds, fold)
    sizes = {r["label"]: r["count"] for r in usable_labels(labels, label, held_out, id_col).groupBy("label").count().collect()}
    sample = labelled_sample(docs, labels, label, held_out, ROWS_PER_CLASS, id_col, text_col)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            found = [terms_of(t) for t in part.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))],
                ["id", "label", "columns", "counts"],
            )

    # the driver gets terms of bounded number, not texts
    rows = sample.mapInArrow(counted, "id bigint, label int, columns array<int>, counts array<double>").toArrow().sort_by("id")
    space = fit_space(matrix_of_table(rows), rows["label"].to_pylist(), sizes)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    # the text travels once, as the column that it is
    named = docs.select(*[F.col(c).alias(f"_c_{c}") for c in docs.columns])
    body = [c.lower() for c in docs.columns].index(text_col.lower())

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 8 << 20):
            found = shared.value.vote([t or "" for t in part.column(body).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, "_score"])

    scored = named.mapInArrow(score, T.StructType([*named.schema.fields, T.StructField("_score", T.DoubleType())]))
    return scored.select(
        *[F.col(f"_c_{c}").alias(c) for c in docs.columns], in_fold(F.col(f"_c_{id_col}"), folds, fold).alias("_held_out"), "_score",
        (F.col("_score") >= at_least).cast("int").alias("_predicted"),
    )
