"""Counterfactual-regularised toxicity classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import batches, texts_of
from terralog.llm.labelled import in_fold, labelled_sample

#: Bounds of the fit: rows per class, and features; both hold for tables of any size.
ROWS_PER_CLASS, FEATURES = 10_000, 4096
#: Rows that must have a feature, weight of the counterfactual penalty, and of squared weights.
LEAST_ROWS, SWAP_PENALTY, RIDGE = 5, 10.0, 2e-5
STEPS = 400

# Identity terms, by kind; within a kind any term may stand for any other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "homosexual", "heterosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"), ("juden", "christen", "muslime", "ausländer"),
    ("femmes", "hommes", "filles", "garçons"), ("juifs", "chrétiens", "musulmans", "étrangers"),
    ("mujeres", "hombres", "chicas", "chicos"), ("judíos", "cristianos", "musulmanes", "extranjeros"),
)

_WORD = re.compile(r"\w+")
_PREFIXES = (4, 5, 6)


def swaps(kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[str, str]:
    """Each identity term and the one that replaces it: the next of its kind."""
    return {term: kind[(k + 1) % len(kind)] for kind in kinds for k, term in enumerate(kind)}


def features_of(words: set[str]) -> set[str]:
    """Words, and beginnings of longer words (marked by a star), which hold word families together."""
    return words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in _PREFIXES))


@dataclass
class Model:
    """Weights by feature, and the score without any."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        get = self.weights.get
        total = self.bias + sum(get(f, 0.0) for f in features_of(set(_WORD.findall(text.lower()))))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit_weights(rows: list[list[int]], swapped: list[list[int] | None], labels: np.ndarray, size: int, penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, with a penalty on the squared change of the linear score by a swap.

    Both labels weigh alike, so that 0.5 parts them however rare one is.
    Full gradients with per-weight step sizes, a fixed number of steps from zero, so the result is the same every time.
    """
    def flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([f for s in sets for f in s], np.int64)

    row, col = flat(rows)
    pairs = [(r, s) for r, s in zip(rows, swapped) if s is not None]
    plus = flat([sorted(set(r) - set(s)) for r, s in pairs])
    minus = flat([sorted(set(s) - set(r)) for r, s in pairs])
    weights, bias = np.zeros(size), 0.0
    share = labels.mean()
    importance = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(rows)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        linear = np.bincount(row, weights[col], len(rows)) + bias
        wrong = (1 / (1 + np.exp(-np.clip(linear, -40, 40))) - labels) * importance
        slope, slope_b = np.bincount(col, wrong[row], size) + 2 * RIDGE * weights, wrong.sum()
        if pairs:
            change = np.bincount(plus[0], weights[plus[1]], len(pairs)) - np.bincount(minus[0], weights[minus[1]], len(pairs))
            pull = 2 * penalty * change / len(pairs)
            slope += np.bincount(plus[1], pull[plus[0]], size) - np.bincount(minus[1], pull[minus[0]], size)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        mb, vb = 0.9 * mb + 0.1 * slope_b, 0.999 * vb + 0.001 * slope_b**2
        rate = 0.1 / (1 + step / 100)
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        bias = bias - rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    return weights, float(bias)


def train(sample: DataFrame, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on labelled rows (body, label), of which there are at most twice ``ROWS_PER_CLASS``.

    Spark counts in how many rows of each label a feature occurs; the ``FEATURES`` with the largest chi-square, and all
    identity terms, become the columns.  Each row's columns, and those of its counterfactual, come to the driver.
    """
    other = swaps(kinds)

    def occurring(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(parts, 1 << 22):
            names, labels = [], []
            for text, label in zip(rows.column("body").to_pylist(), rows.column("label").to_pylist()):
                found = features_of(set(_WORD.findall(text.lower())))
                names.extend(found)
                labels.extend([label] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(labels, pa.int32())], ["feature", "label"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, 40.0 if bad else -40.0)
    counts = sample.mapInArrow(occurring, "feature string, label int").filter(F.length("feature") <= 64).groupBy("feature").agg(
        F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all")
    )
    expected = F.col("all") * F.lit(bad / (bad + good))
    chi = (F.col("bad") - expected) ** 2 / expected
    best = counts.filter(F.col("all") >= LEAST_ROWS).orderBy(F.desc(chi), "feature").limit(FEATURES).select("feature").collect()
    names = sorted({r["feature"] for r in best} | set(other))
    column = {n: k for k, n in enumerate(names)}

    def columns_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = column.keys()
        for rows in batches(parts):
            own, swapped = [], []
            for text in rows.column("body").to_pylist():
                words = set(_WORD.findall(text.lower()))
                own.append([column[f] for f in features_of(words) & known])
                turned = {other.get(w, w) for w in words}
                swapped.append([column[f] for f in features_of(turned) & known] if turned != words else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("label"), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["label", "own", "swapped"]
            )

    table = sample.mapInArrow(columns_of, "label int, own array<int>, swapped array<int>").toArrow()
    rows = sorted(zip((sorted(r) for r in table["own"].to_pylist()), table["label"].to_pylist(), table["swapped"].to_pylist()), key=repr)
    weights, bias = fit_weights([r[0] for r in rows], [r[2] for r in rows], np.array([r[1] for r in rows], float), len(names), penalty)
    return Model({n: float(w) for n, w in zip(names, weights)}, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from 0.5 on); learnt from rows not held out.

    Every whole text is scored by its words and their beginnings.  A null or empty text has the score of no features.
    Without labelled rows of both classes the score is that of the only one, or near 0.  Repeated rows score alike; a
    null id is not held out and never trained on.
    """
    model = train(labelled_sample(docs, labels, label, in_fold(F.col(id_col), folds, fold), ROWS_PER_CLASS, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(parts):
            found = [shared.value.score(t) for t in rows.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    plain = texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    scored = plain.mapInArrow(score, "id bigint, score double")
    return scored.select(F.col("id").alias(id_col), in_fold(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
