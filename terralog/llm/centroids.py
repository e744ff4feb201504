"""Centroid clustering in whole numbers, where bounds by plane geometry spare most vectors the comparison with all centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import discard, freeze_at
from terralog.session import freeze

SCALE = 1024
MOST = 1 << 27  # components are held within +-MOST, so that a squared distance of 64 components fits a long
ARCS = 64
MARGIN = 1e-9  # relative; bounds are in double precision, far coarser than its rounding
AGAIN = 0.25  # share of vectors compared in full from which new bounds are worth a pass


def whole_vectors(vectors: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of vectors with ``size`` finite components: floor(1024 * x) each, held within +-2^27."""
    x = F.col(vector_col)
    good = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(float(-MOST))), F.lit(float(MOST))).cast("int"))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), held.alias("v"))


def seeds(kept: DataFrame, k: int, salt: str = "3:") -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``salt`` and id, in that order (ties: smaller vector; a null id counts as empty)."""
    named = kept.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    return np.array([r.v for r in named.orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column per centroid."""
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1) if len(v) else np.zeros((0, len(centroids)), np.int64)


def farthest_gain(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """An upper bound of |x - old| - |x - new| over all x within ``radius`` of ``centre``: how far a lower bound may fall.

    The difference depends on the place t along the line through both points and on the distance y from it, so a ball
    becomes a disc in that half plane, and the largest difference lies on its edge.  The edge is cut into arcs; within
    one, the difference is at most that of the largest t and the smallest y (the largest, behind the middle).  It is
    never more than the drift |old - new|, which triangle inequality alone would give.
    """
    drift = float(np.linalg.norm(new - old))
    if drift == 0:
        return 0.0
    along, off = (new - old) / drift, centre - (old + new) / 2
    t0 = float(off @ along)
    y0 = float(np.sqrt(max(0.0, float(off @ off) - t0 * t0)))
    angle = np.linspace(0, 2 * np.pi, ARCS + 1)
    t, y = t0 + radius * np.cos(angle), y0 + radius * np.sin(angle)
    t = np.maximum(t[:-1], t[1:])
    near = np.where(y[:-1] * y[1:] <= 0, 0.0, np.minimum(abs(y[:-1]), abs(y[1:])))
    y = np.where(t > 0, near, np.maximum(abs(y[:-1]), abs(y[1:])))
    both = np.hypot(t + drift / 2, y) + np.hypot(t - drift / 2, y)
    return min(drift, float((2 * drift * t / np.maximum(both, drift)).max()))


def loosened(anchor: np.ndarray, radius: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cluster of the anchor: how much the own distance may have grown, and the distance to the second one fallen."""
    a, b, k = anchor.astype(float), now.astype(float), len(anchor)
    grown = np.linalg.norm(b - a, axis=1)
    fallen = np.array([max((farthest_gain(a[i], radius[i], a[j], b[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])
    return grown, fallen


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    column = batch.column("v")
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(-1, size).astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, size).astype(np.int64)


def _anchored(rows: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """(vec_id, v, cluster, own, other): the nearest centroid, the distance to it and to the second nearest."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            v = _vectors(batch, size)
            d = squared(v, centroids)
            cluster = d.argmin(axis=1)
            own = np.sqrt(d[np.arange(len(d)), cluster].astype(float))
            d[np.arange(len(d)), cluster] = np.iinfo(np.int64).max
            other = np.sqrt(d.min(axis=1, initial=np.iinfo(np.int64).max).astype(float))
            packed = pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), packed, pa.array(cluster.astype(np.int32)), pa.array(own), pa.array(other)], ["vec_id", "v", "cluster", "own", "other"]
            )

    return rows.mapInArrow(place, "vec_id bigint, v binary, cluster int, own double, other double")


def _nearest(v: np.ndarray, batch: pa.RecordBatch, centroids: np.ndarray, grown: np.ndarray, fallen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Clusters now and at the anchor, and how many vectors had to be compared in full."""
    old = batch.column("cluster").to_numpy()
    above, below = batch.column("own").to_numpy() + grown[old], batch.column("other").to_numpy() - fallen[old]
    open_rows = np.flatnonzero(~(above + MARGIN * (1 + above + abs(below)) < below))
    cluster = old.astype(np.int64)
    cluster[open_rows] = squared(v[open_rows], centroids).argmin(axis=1)
    return cluster, old, len(open_rows)


_SUMS = "cluster int, at int, value bigint"  # at -1: vectors, at -2: vectors compared in full (cluster 0)


def _sum_rows(total: np.ndarray, count: np.ndarray, scanned: int) -> pa.RecordBatch:
    k, size = total.shape
    cluster = np.concatenate([np.repeat(np.arange(k), size), np.arange(k), [0]]).astype(np.int32)
    at = np.concatenate([np.tile(np.arange(size), k), np.full(k, -1), [-2]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(at), pa.array(np.concatenate([total.ravel(), count, [scanned]]))], ["cluster", "at", "value"])


def _collected(rows: DataFrame, k: int, size: int) -> tuple[list[list[int]], list[int], int]:
    """Sums and counts per cluster, added up over the tasks; k * (size + 1) + 1 rows reach the driver, whatever the table."""
    total, count, scanned = [[0] * size for _ in range(k)], [0] * k, 0
    for r in rows.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        if r["at"] >= 0:
            total[r["cluster"]][r["at"]] = int(r["value"])
        elif r["at"] == -1:
            count[r["cluster"]] = int(r["value"])
        else:
            scanned = int(r["value"])
    return total, count, scanned


def _summed(anchor: DataFrame, k: int, size: int) -> tuple[list[list[int]], list[int], int]:
    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in parts:
            v, cluster = _vectors(batch, size), batch.column("cluster").to_numpy()
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=k)
        yield _sum_rows(total, count, 0)

    return _collected(anchor.select("v", "cluster").mapInArrow(add, _SUMS), k, size)


def _moved(anchor: DataFrame, centroids: np.ndarray, grown: np.ndarray, fallen: np.ndarray, size: int) -> tuple[list[list[int]], list[int], int]:
    """What has to be added to the anchor's sums and counts, from the vectors that are in another cluster now."""
    k = len(centroids)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, scanned = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
        for batch in parts:
            v = _vectors(batch, size)
            cluster, old, some = _nearest(v, batch, centroids, grown, fallen)
            scanned += some
            went = np.flatnonzero(cluster != old)
            np.add.at(total, cluster[went], v[went])
            np.subtract.at(total, old[went], v[went])
            count += np.bincount(cluster[went], minlength=k) - np.bincount(old[went], minlength=k)
        yield _sum_rows(total, count, scanned)

    return _collected(anchor.select("v", "cluster", "own", "other").mapInArrow(add, _SUMS), k, size)


def _assigned(anchor: DataFrame, centroids: np.ndarray, grown: np.ndarray, fallen: np.ndarray, size: int) -> DataFrame:
    """(vec_id, cluster, distance) under the last centroids; the distance is exact and squared."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            v = _vectors(batch, size)
            cluster, _, _ = _nearest(v, batch, centroids, grown, fallen)
            distance = ((v - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return anchor.mapInArrow(place, "vec_id bigint, cluster int, distance bigint")


def _radii(anchor: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k)
    for r in anchor.groupBy("cluster").agg(F.max("own").alias("own")).collect():
        out[r.cluster] = r.own * (1 + MARGIN)
    return out


_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k-means of whole vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row per kept vector.

    An anchor table holds each vector with its cluster, its distance to that centroid and to the second nearest.  In the
    rounds after, the centroids have moved, and per cluster a disc in the plane of (its centre, an old and a new centroid)
    tells how much the second distance can have fallen (``farthest_gain``), mostly less than the whole drift.  A vector
    whose two distances cannot have crossed stays; the others are compared with all centroids, exactly, and only what
    they change is added to the anchor's sums.  When many had to be compared, a new anchor is written.  Bounds decide
    nothing but which vectors are compared, so the result is that of the plain algorithm, ties included.

    Vectors with another number of components, or with a null or non-finite one, are left out; so are null vectors.
    Repeated rows and ids count as often as they occur.  Fewer than ``k`` vectors give as many centroids, none give no
    rows.  Components beyond 2^27 in 1/1024 are held there.  Inertias beyond a long become null.
    """
    kept = whole_vectors(vectors, size, id_col, vector_col)
    centroids = seeds(kept, k)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    k, anchor, place, scanned = len(centroids), None, None, 0
    for _ in range(rounds):
        if anchor is None or scanned > AGAIN * sum(counts):
            before = place
            anchor, place = freeze_at(_anchored((kept if anchor is None else anchor).select("vec_id", "v"), centroids, size), "anchor")
            if before:
                discard(spark, before)
            base, radius = centroids, _radii(anchor, k)
            sums, counts, scanned = _summed(anchor, k, size)
            total, count = sums, counts
        else:
            change, by, scanned = _moved(anchor, centroids, *loosened(base, radius, centroids), size)
            total = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, change)]
            count = [a + b for a, b in zip(counts, by)]
        centroids = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(total, count, centroids)], dtype=np.int64)
    if anchor is None:
        anchor, place = freeze_at(_anchored(kept, centroids, size), "anchor")
        base, radius = centroids, _radii(anchor, k)
    placed = freeze(_assigned(anchor, centroids, *loosened(base, radius, centroids), size))
    discard(spark, place)
    parts = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    about = [(c, fits(parts.get(c, 0)), fits(sum(parts.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
