"""Streams with their own state per key (``transformWithStateInPandas``; needs the RocksDB state store).

Arrival order decides: rows of one key within a micro-batch are put in their order columns first, and batches are taken
as they come.  How many rows a batch holds is set at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terralog.functions import geodesy
from terralog.operators.points import VOXEL, fold_observations, units, voxel_columns
from terralog.streaming.stateless import event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER_CONF, ROCKSDB)


def _ordered(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    parts = [p for p in rows if len(p)]
    return pd.concat(parts, ignore_index=True).sort_values(list(order), kind="stable") if parts else pd.DataFrame()


class _JsonState(StatefulProcessor):
    """State of a key as one JSON text; subclasses give ``advance(state, rows) -> (state, output)``."""

    def __init__(self, order: Sequence[str], ttl_ms: int | None = None):
        self.order, self.ttl_ms = list(order), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("value", T.StringType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _ordered(rows, self.order)
        if ordered.empty:
            return
        before = json.loads(self.state.get()[0]) if self.state.exists() else None
        after, out = self.advance(before, ordered)
        self.state.update((json.dumps(after),))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class _InOrder(_JsonState):
    """The same, across batches: rows wait in the state until the watermark has passed them, and are then advanced in order.

    ``fields`` are the row's columns, with the stamp in nanoseconds.  What waits is what arrived within the watermark's delay.
    """

    def __init__(self, order: Sequence[str], fields: T.StructType, stamp: str):
        super().__init__(order)
        self.fields, self.stamp = fields, stamp

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", self.fields)

    def _wake(self, stamps) -> None:
        self.handle.registerTimer(-(-int(min(stamps)) // 1_000_000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p[self.fields.names] for p in rows if len(p)]
        if parts:
            arrived = pd.concat(parts, ignore_index=True)
            self.waiting.appendList(list(arrived.astype(object).itertuples(index=False, name=None)))
            self._wake(arrived[self.stamp])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.waiting.get()), columns=self.fields.names)
        ready = held[self.stamp].astype("int64") // 1000 < timerValues.getCurrentWatermarkInMs() * 1000
        rest = held[~ready]
        if len(rest):
            self.waiting.put(list(rest.astype(object).itertuples(index=False, name=None)))
            self._wake(rest[self.stamp])
        else:
            self.waiting.clear()
        if ready.any():
            ordered = held[ready].sort_values(self.order, kind="stable").infer_objects()
            before = json.loads(self.state.get()[0]) if self.state.exists() else None
            after, out = self.advance(before, ordered)
            self.state.update((json.dumps(after),))
            if len(out):
                yield out


def _apply(df: DataFrame, key: Sequence[str], processor: StatefulProcessor, schema: T.StructType, mode: str = "Append", time: str = "None") -> DataFrame:
    return df.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


# --- rate gate ---------------------------------------------------------------------------------------------------------


class _Gate:
    def gate(self, stamp, interval, strict):
        self.stamp, self.interval, self.strict = stamp, interval, strict
        return self

    def advance(self, state, rows):
        stamps = rows[self.stamp].to_numpy()
        kept, last, at = [], None if state is None else state[0], 0
        side = "right" if self.strict else "left"
        while at < len(stamps):
            if last is not None:
                at += int(np.searchsorted(stamps[at:], last + self.interval, side=side))
                if at >= len(stamps):
                    break
            kept.append(at)
            last = stamps[at].item()
            at += 1
        return [last], rows.iloc[kept]


class _RateGate(_Gate, _JsonState):
    pass


class _OrderedRateGate(_Gate, _InOrder):
    pass


def stream_rate_gate(
    df: DataFrame, key: Sequence[str], interval, stamp: str = "stamp_ns", tie: Sequence[str] = ("row_id",), strict: bool = False, watermark: str | None = None
) -> DataFrame:
    """The gate in the order of arrival; with a ``watermark``, in the order of stamps, whichever batch a row came in."""
    order = [stamp, *tie]
    if watermark is None:
        return _apply(df, key, _RateGate(order).gate(stamp, interval, strict), df.schema)
    timed = df.withColumn("event_time", event_time(F.col(stamp))).withWatermark("event_time", watermark)
    return _apply(timed, key, _OrderedRateGate(order, df.schema, stamp).gate(stamp, interval, strict), df.schema, "Append", "EventTime")


# --- voxels and surfels ------------------------------------------------------------------------------------------------


class _FirstPoint(_JsonState):
    def advance(self, state, rows):
        return [1], rows.iloc[:1] if state is None else rows.iloc[:0]


def stream_voxels(points: DataFrame, size: float, order: Sequence[str] = ("stamp_ns", "seq"), key: Sequence[str] = ("session_id",), ttl_ms: int | None = None) -> DataFrame:
    """First point of each cell, once; cells are the state keys, so a session spreads over all tasks."""
    cells = points.withColumns(voxel_columns(size))
    return _apply(cells, [*key, *VOXEL], _FirstPoint(order, ttl_ms), cells.schema)


class _Surfel(_JsonState):
    def __init__(self, order, key, voxel):
        super().__init__(order)
        self.key, self.voxel = key, voxel

    def advance(self, state, rows):
        observed = rows[["x", "y", "z", "r", "g", "b"]].to_numpy(dtype=float)
        ways = units(rows[["ox", "oy", "oz"]].to_numpy(dtype=float) - observed[:, :3])
        n, mean, normal = fold_observations((state or [0, None, None])[:3], observed.tolist(), ways.tolist())
        updated = int(rows["stamp_ns"].iloc[-1])
        out = rows.iloc[:1][self.key].assign(
            **dict(zip(("x", "y", "z"), mean[:3])),
            **{c: int(max(0.0, min(255.0, np.floor(v + 0.5)))) for c, v in zip("rgb", mean[3:])},
            **dict(zip(("nx", "ny", "nz"), normal)),
            observation_count=n, updated_at=updated, confidence=min(1.0, 0.2 + 0.04 * (n - 1)), radius=self.voxel * 0.75,
        )
        return [n, mean, normal, updated], out


def stream_surfels(points: DataFrame, voxel: float = 0.04, order: Sequence[str] = ("stamp_ns", "seq"), key: Sequence[str] = ("session_id",)) -> DataFrame:
    """Fused surfel of each cell that a batch touched (update rows).  ``points.trim_surfels`` over the newest row per
    cell enforces the cap in ``foreachBatch``."""
    finite = points.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz"))
    used = dict.fromkeys([*key, *order, "stamp_ns", *"xyzrgb", "ox", "oy", "oz"])
    cells = finite.select(*used).withColumns(voxel_columns(voxel))
    fields = [cells.schema[c] for c in (*key, *VOXEL)]
    fields += [T.StructField(c, T.DoubleType()) for c in "xyz"] + [T.StructField(c, T.LongType()) for c in "rgb"]
    fields += [T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz")]
    fields += [T.StructField("observation_count", T.LongType()), T.StructField("updated_at", T.LongType())]
    fields += [T.StructField("confidence", T.DoubleType()), T.StructField("radius", T.DoubleType())]
    return _apply(cells, [*key, *VOXEL], _Surfel(order, [*key, *VOXEL], voxel), T.StructType(fields), "Update")


# --- staleness ---------------------------------------------------------------------------------------------------------


class _Staleness(StatefulProcessor):
    """Holds the newest stamp and whether its silence was reported; silences inside a batch are reported from the data."""

    def __init__(self, key: str, seconds: float):
        self.key, self.wait_ns = key, int(seconds * 1e9)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("stamp_ns", T.LongType()), T.StructField("told", T.BooleanType())]))

    def _rows(self, key, stamps) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(stamps), "last_ns": stamps})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps = np.sort(np.concatenate([p["stamp_ns"].to_numpy() for p in rows] or [np.empty(0, dtype=np.int64)]))
        before, told = self.last.get() if self.last.exists() else (None, False)
        if len(stamps) == 0 or (before is not None and stamps[-1] <= before):
            return
        fresh = stamps if before is None else stamps[stamps > before]
        line = fresh if before is None else np.concatenate([[before], fresh])
        silent = np.diff(line) > self.wait_ns
        if before is not None and told:
            silent[0] = False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        newest = int(stamps[-1])
        self.last.update((newest, False))
        self.handle.registerTimer((newest + self.wait_ns) // 1_000_000 + 1)
        if silent.any():
            yield self._rows(key, line[:-1][silent])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, told = self.last.get()
        if not told:
            self.last.update((newest, True))
            yield self._rows(key, [newest])

    def close(self) -> None:
        pass


def stream_staleness(fixes: DataFrame, seconds: float = 10.0, watermark: str = "1 second", key: str = "session_id") -> DataFrame:
    """One row (the last stamp before it) for each time a session had no fix for ``seconds`` of event time: as soon as the
    watermark shows it, or from the next fix, whichever comes first."""
    timed = fixes.withColumn("event_time", event_time(F.col("stamp_ns"))).withWatermark("event_time", watermark)
    schema = T.StructType([fixes.schema[key], T.StructField("last_ns", T.LongType())])
    return _apply(timed.select(key, "stamp_ns", "event_time"), [key], _Staleness(key, seconds), schema, "Append", "EventTime")


# --- published keys ----------------------------------------------------------------------------------------------------


class _Published(StatefulProcessor):
    """Keys that were published, until the session's next reset (rows with ``is_reset``)."""

    def __init__(self, order: Sequence[str], name: str, kept: Sequence[str]):
        self.order, self.name, self.kept = list(order), name, list(kept)

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = T.StructType([T.StructField("key", T.StringType())])
        self.seen = handle.getMapState("seen", text, T.StructType([T.StructField("told", T.BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # on equal stamps a reset comes first
        parts = [p.assign(plain_row=~p["is_reset"].astype(bool)) for p in rows if len(p)]
        ordered = _ordered(iter(parts), [self.order[0], "plain_row", *self.order[1:]])
        if ordered.empty:
            return
        run = ordered["is_reset"].astype(bool).cumsum()
        plain = ordered["plain_row"]
        fresh = ordered[plain].assign(run_number=run[plain]).drop_duplicates(["run_number", self.name])
        # what was told before counts until the first reset of the batch; what counts after the batch is told since its last
        last = int(run.iloc[-1])
        new = np.array([n > 0 or not self.seen.containsKey((k,)) for n, k in zip(fresh["run_number"], fresh[self.name])], dtype=bool)
        if last > 0:
            self.seen.clear()
        for k in fresh[self.name][new & (fresh["run_number"] == last).to_numpy()]:
            self.seen.updateValue((k,), (True,))
        if new.any():
            yield fresh[new][self.kept]

    def close(self) -> None:
        pass


def stream_unpublished(
    rows: DataFrame, resets: DataFrame, dedup_key: str = "dedup_key", order: Sequence[str] = ("stamp_ns", "seq"), key: str = "session_id", spread: int = 16
) -> DataFrame:
    """The first row of each key in a session: a key is never forgotten until the session is reset (``resets``: key and order).

    Keys live in the state store, a row each, and a session is spread over ``spread`` parts by the hash of its keys; a reset
    reaches all of them.  A null key is a key.  (Pandas renames columns that begin with an underscore, so helper columns don't.)
    """
    named = F.coalesce(F.col(dedup_key).cast("string"), F.lit("\0")).alias("key_text")
    columns = [c for c in rows.columns if c != key]
    left = rows.select(key, F.pmod(F.xxhash64(named), F.lit(spread)).alias("spread_part"), F.lit(False).alias("is_reset"), named, *columns)
    right = resets.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("spread_part"), F.lit(True).alias("is_reset"), *order)
    both = left.unionByName(right, allowMissingColumns=True)
    return _apply(both, [key, "spread_part"], _Published(order, "key_text", rows.columns), rows.schema)


# --- origin ------------------------------------------------------------------------------------------------------------


class _Placing:
    def placing(self, key: str, max_accuracy: float):
        self.key, self.max_accuracy = key, max_accuracy
        return self

    def advance(self, state, rows):
        pose, origin = state or [None, None]
        out = []
        for row in rows.itertuples(index=False):
            if row.side == -1:
                pose, origin = None, None
            elif row.side == 0:
                pose = [row.x, row.y, row.z]
            else:
                usable = bool(np.isfinite([row.lat, row.lon, row.alt]).all())
                if usable and origin is None and pose is not None and np.isfinite(row.hacc) and 0 <= row.hacc <= self.max_accuracy:
                    origin = [row.lat, row.lon, row.alt, *pose]
                reason = None if origin else ("waiting_for_accurate_gps_origin" if pose else "waiting_for_arkit_map_pose")
                out.append((getattr(row, self.key), int(row.stamp_ns), int(row.seq), row.lat, row.lon, row.alt, usable, reason, *(origin or [None] * 6)))
        names = [self.key, "stamp_ns", "seq", "lat", "lon", "alt", "usable", "reason", "olat", "olon", "oalt", "mx", "my", "mz"]
        return [pose, origin], pd.DataFrame(out, columns=names).astype({c: "float64" for c in ("olat", "olon", "oalt", "mx", "my", "mz")})


class _Origin(_Placing, _JsonState):
    pass


class _OrderedOrigin(_Placing, _InOrder):
    pass


def stream_origin(
    fixes: DataFrame, poses: DataFrame, starts: DataFrame | None = None, max_accuracy: float = 25.0, key: str = "session_id", watermark: str | None = None
) -> DataFrame:
    """Live georeference: the newest pose is held, the first good fix becomes the origin, a session start resets both.

    Without a ``watermark`` the order of arrival counts.  With one, rows wait until it has passed them and are taken in the
    order of their stamps, so a pose that comes a batch after its fix still counts, as in ``geo.georeference``.  The state
    only finds the origin; positions are Column expressions on the output.
    """
    def side(df: DataFrame, number: int) -> DataFrame:
        def number_or_null(name: str):
            return (F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")).alias(name)

        return df.select(key, "stamp_ns", F.lit(number).alias("side"), F.col("seq").cast("bigint").alias("seq"), *[number_or_null(c) for c in ("x", "y", "z", "lat", "lon", "alt", "hacc")])

    rows = side(poses, 0).unionByName(side(fixes, 1))
    if starts is not None:
        rows = rows.unionByName(side(starts, -1))
    schema = T.StructType(
        [fixes.schema[key], T.StructField("stamp_ns", T.LongType()), T.StructField("seq", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "alt")]
        + [T.StructField("usable", T.BooleanType()), T.StructField("reason", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("olat", "olon", "oalt", "mx", "my", "mz")]
    )
    order = ["stamp_ns", "side", "seq"]
    if watermark is None:
        found = _apply(rows, [key], _Origin(order).placing(key, max_accuracy), schema)
    else:
        timed = rows.withColumn("event_time", event_time(F.col("stamp_ns"))).withWatermark("event_time", watermark)
        found = _apply(timed, [key], _OrderedOrigin(order, rows.schema, "stamp_ns").placing(key, max_accuracy), schema, "Append", "EventTime")
    c = F.col
    enu = geodesy.to_enu(geodesy.to_ecef(c("lat"), c("lon"), c("alt")), geodesy.to_ecef(c("olat"), c("olon"), c("oalt")), c("olat"), c("olon"))
    at = F.struct(c("mx").alias("x"), c("my").alias("y"), c("mz").alias("z"))
    known = c("reason").isNull() & c("usable")
    placed = found.withColumn("enu", F.when(known, enu))
    return placed.withColumn("map", F.when(known, geodesy.enu_to_map(c("enu"), at)))
