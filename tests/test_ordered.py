"""Order-dependent operators: small keys and hot keys give the same rows, and both agree with a plain loop."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.operators import calibration, gates, geo, joins, points, quality, telemetry
from terralog.operators.ordered import OrderedRows, fold_rows, key_stream
from tests.conftest import rows

HOT = 16


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    out, stamp = [], {"a": 0, "b": 0, "c": 0}
    for i in range(400):
        # one key holds most of the rows
        key = "a" if rng.random() < 0.8 else rng.choice("bc")
        stamp[key] += rng.choice([0, 1, 1, 2, 3, 9])
        out.append((key, stamp[key], i, rng.choice([None, None, i]), rng.randint(1, 40)))
    return out


@pytest.fixture(scope="module")
def frame(spark, log):
    return spark.createDataFrame(log, "k string, ts bigint, id bigint, v bigint, bytes bigint").repartition(5)


def by_key(log):
    out = {}
    for r in log:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[3, 10_000])
def batch_rows(spark, request):
    """Rows of an Arrow batch: few, so that a key goes on from batch to batch, or many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("limit, width", [(None, None), (HOT, None), (None, 5), (None, 10**9)])
def test_carry_previous_total_rank(frame, log, limit, width):
    o = OrderedRows(frame, ["k"], ["ts", "id"], limit, width=width)
    assert o.hot == (limit is not None or width is not None)
    o.carry("last", F.col("v")).carry("ahead", F.col("v"), reverse=True).first_seen("first", F.col("v")).previous("before", "id").cumulative("sum", F.col("bytes")).rank("n").total("all", F.col("bytes"))
    got = {r["id"]: r for r in o.result().collect()}
    for part in by_key(log).values():
        last, total, before = None, 0, None
        for n, r in enumerate(part, 1):
            last = r[3] if r[3] is not None else last
            total += r[4]
            assert got[r[2]]["first"] == next((x[3] for x in part[:n] if x[3] is not None), None)
            ahead = next((x[3] for x in part[n - 1 :] if x[3] is not None), None)
            g = got[r[2]]
            assert (g["last"], g["ahead"], g["sum"], g["n"], g["all"]) == (last, ahead, total, n, sum(x[4] for x in part))
            assert (g["before"]["id"] if g["before"] else None) == before
            before = r[2]


@pytest.mark.parametrize("strict", [False, True])
def test_rate_gate(frame, log, batch_rows, strict):
    got = {r["id"] for r in gates.rate_gate(frame, ["k"], 5, stamp="ts", tie=["id"], strict=strict).collect()}
    want = set()
    for part in by_key(log).values():
        last = None
        for r in part:
            if last is None or (r[1] - last > 5 if strict else r[1] - last >= 5):
                want.add(r[2])
                last = r[1]
    assert got == want


@pytest.mark.parametrize("size", [1, 60, 100])
def test_assign_chunks(frame, log, batch_rows, size):
    got = {r["id"]: r["chunk"] for r in gates.assign_chunks(frame, size, ["k"], ["id"]).collect()}
    for part in by_key(log).values():
        chunk, held, count = 0, 0, 0
        for r in part:
            if count and held + r[4] > size:
                chunk, held, count = chunk + 1, 0, 0
            held, count = held + r[4], count + 1
            assert got[r[2]] == chunk


def test_one_key_of_many_rows_in_little_memory(spark):
    """Five million rows of one key; the Python worker may take 200 MB more than it has at the start."""
    import pyarrow as pa

    def handle(state, rows: pa.RecordBatch):
        import resource

        count, low = state or (0, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
        count += rows.num_rows
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - low
        return (count, low), pa.RecordBatch.from_arrays([rows.column("k")[:1], pa.array([count]), pa.array([grown])], ["k", "n", "grown"])

    rows_ = spark.range(5_000_000).select(F.lit("x").alias("k"), F.col("id").alias("ts"), F.lit(7).alias("bytes"))
    out = key_stream(rows_, ["k"], ["ts"], handle, T.StructType.fromDDL("k string, n bigint, grown bigint")).agg(F.max("n"), F.max("grown")).first()
    assert out[0] == 5_000_000 and out[1] < 200_000
    chunks = gates.assign_chunks(rows_, 7_000, ["k"], ["ts"]).agg(F.max("chunk"), F.count("*")).first()
    assert tuple(chunks) == (4_999, 5_000_000)
    assert gates.rate_gate(rows_, ["k"], 1000, stamp="ts", tie=[]).count() == 5_000


def test_keys_that_are_null_or_end_with_a_batch(spark, batch_rows):
    data = [(k, i) for k in (None, "a", "b") for i in range(6)]
    df = spark.createDataFrame(data, "k string, id bigint")

    def step(state, part: pd.DataFrame):
        n = state or 0
        return n + len(part), part.assign(n=range(n + 1, n + len(part) + 1))

    got = fold_rows(df, ["k"], ["id"], step, T.StructType.fromDDL("k string, id bigint, n bigint")).collect()
    assert sorted((r["k"] or "", r["id"], r["n"]) for r in got) == sorted((k or "", i, i + 1) for k, i in data)


@pytest.mark.parametrize("limit, width", [(None, None), (HOT, None), (None, 4), (None, 10**9)])
@pytest.mark.parametrize("tolerance", [None, 2])
def test_asof(spark, frame, log, limit, width, tolerance):
    right = frame.filter("id % 3 = 0").select("k", "ts", "id", F.col("id").alias("match"))
    out = joins.asof_join(frame, right, ["k"], "ts", "ts", ["match"], left_tie=["id"], right_tie=["id"], tolerance=tolerance, limit=limit, width=width)
    got = {r["id"]: r["match"] for r in out.collect()}
    for r in log:
        found = [x for x in log if x[0] == r[0] and x[2] % 3 == 0 and x[1] <= r[1]]
        best = max(found, key=lambda x: (x[1], x[2]), default=None)
        want = best[2] if best and (tolerance is None or r[1] - best[1] <= tolerance) else None
        assert got[r[2]] == want


def test_fold_is_sequential(frame, log, batch_rows):
    """A state that never forgets."""
    schema = T.StructType.fromDDL("k string, id bigint, sum bigint")

    def step(state, part: pd.DataFrame):
        total = state[0] if state else 0
        sums = []
        for b in part["bytes"]:
            total = (total * 3 + int(b)) % 1009
            sums.append(total)
        return [total], part[["k", "id"]].assign(sum=sums)

    got = {r["id"]: r["sum"] for r in fold_rows(frame, ["k"], ["id"], step, schema).collect()}
    for part in by_key(log).values():
        total = 0
        for r in part:
            total = (total * 3 + r[4]) % 1009
            assert got[r[2]] == total


def session_rows(spark, n=600):
    """All rows of one session, in steps of 0.1 to 90 seconds."""
    rng, stamp, out = random.Random(9), 0, []
    for i in range(n):
        stamp += int(rng.choice([0.1, 1, 30, 90]) * 1e9)
        out.append(("s", "t", stamp, i, i, stamp + i, float(i), 0.5, 0.1, 0.0, 0.0, 0.6, 0.8, rng.choice(["nominal", "hot?", "serious"])))
    cols = "session_id string, topic string, stamp_ns bigint, seq bigint, row_id bigint, recv_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double, state string"
    return spark.createDataFrame(out, cols)


@pytest.mark.parametrize("width", [1, 45 * 10**9, 10**15])
def test_one_session_of_all_rows(spark, width):
    """Operators that look back give the rows of a plain window, whatever the stretch."""
    df = session_rows(spark)
    same = lambda make: rows(make(width)) == rows(make(None))
    assert same(lambda w: telemetry.staleness(df, ["session_id"], "stamp_ns", "seq", 20.0, width=w).select("seq", "gap_s", "stale"))
    assert same(lambda w: telemetry.thermal_interval(df, ["session_id"], ["stamp_ns", "seq"], width=w).select("seq", "interval_s"))
    assert same(lambda w: geo.odometry_twist(df, width=w).select("seq", "vx", "vy", "vz", "wx", "wy", "wz"))
    assert same(lambda w: quality.check_clock(df, width=w).select("messages", "backward_steps"))
    assert same(lambda w: joins.asof_join(df, df.filter("seq % 50 = 0").withColumnRenamed("x", "px"), ["session_id"], "stamp_ns", "stamp_ns", ["px"], left_tie=["seq"], right_tie=["seq"], width=w).select("seq", "px"))
    fixes = df.select("session_id", "stamp_ns", "seq", (F.lit(40) + F.col("seq") / 1000).alias("lat"), F.lit(-105.0).alias("lon"), F.lit(1600.0).alias("alt"), F.when(F.col("seq") < 300, 90.0).otherwise(5.0).alias("hacc"))
    placed = lambda w: rows(geo.georeference(fixes, df.filter("seq % 7 = 0"), width=w).select("seq", "reason", "established", "map.x", "map.y", "map.z", "origin.seq"))
    assert placed(width) == placed(None)


def _observations(spark, n=300):
    rng = random.Random(5)
    data = [("s", i, i, rng.uniform(0, 0.9), rng.uniform(0, 0.9), 0.1, rng.randint(0, 255), 10, 20, rng.uniform(-3, 3), rng.uniform(-3, 3), 5.0) for i in range(n)]
    data += [("s", i, 1000 + i, 5.0 + i * 0.3, 0.2, 0.2, 100, 100, 100, 0.0, 0.0, 0.0) for i in range(5)]
    return data, spark.createDataFrame(data, "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, r int, g int, b int, ox double, oy double, oz double")


@pytest.mark.parametrize("limit", [None, 40])
def test_surfels_follow_the_running_mean(spark, limit):
    import numpy as np

    data, df = _observations(spark)
    got = {(r["vx"], r["vy"], r["vz"]): r for r in points.fuse_surfels(df, 1.0, limit=limit).collect()}
    cells = {}
    for row in data:
        cells.setdefault(tuple(int(np.floor(v)) for v in row[3:6]), []).append(row)
    assert set(got) == set(cells)
    for cell, part in cells.items():
        n, mean, normal = 0, None, None
        for row in part:
            value, towards = np.array(row[3:9], dtype=float), np.array(row[9:12]) - np.array(row[3:6])
            towards = towards / np.linalg.norm(towards)
            w = min(n, 64)
            mean = value if n == 0 else (mean * w + value) / (w + 1)
            normal = towards if n == 0 else normal * w + towards
            normal = normal / np.linalg.norm(normal)
            n += 1
        g = got[cell]
        assert g["observation_count"] == n and abs(g["confidence"] - min(1, 0.2 + 0.04 * (n - 1))) < 1e-9
        assert max(abs(g[c] - m) for c, m in zip("xyz", mean)) < 1e-9 and abs(g["r"] - mean[3]) <= 0.5 + 1e-6
        assert max(abs(g[c] - m) for c, m in zip(("nx", "ny", "nz"), normal)) < 1e-9


def test_normals_of_a_crowded_cell_seen_from_both_sides(spark, batch_rows):
    """The first 1500 observations see one side, the others two sides in turn: the past stays in the normal."""
    import numpy as np

    rng = random.Random(8)
    data = []
    for i in range(9000):
        side = 4.0 if i < 1500 or i % 2 else -4.0
        data.append(("s", i, i, rng.uniform(0, 0.9), rng.uniform(0, 0.9), 0.1, 1, 1, 1, side, rng.uniform(-3, 3), 9.0 if i < 1500 else 0.1))
    df = spark.createDataFrame(data, "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, r int, g int, b int, ox double, oy double, oz double")
    g = points.fuse_surfels(df, 1.0).collect()
    assert len(g) == 1 and g[0]["observation_count"] == len(data)

    def folded(part):
        normal, n = np.zeros(3), 0
        for row in part:
            towards = np.array(row[9:12]) - np.array(row[3:6])
            normal = normal * min(n, 64) + towards / np.linalg.norm(towards)
            normal, n = normal / np.linalg.norm(normal), n + 1
        return normal

    want = folded(data)
    assert max(abs(g[0][c] - m) for c, m in zip(("nx", "ny", "nz"), want)) < 1e-9
    assert max(abs(folded(data[-4096:]) - want)) > 1e-6


@pytest.mark.parametrize("width", [None, 10**9])
def test_reused_calibration(spark, batch_rows, width):
    def matrix(x):
        return [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]

    data = [("s", 1, 10.0, 2.0, 0.0), ("s", 2, 10.5, 3.0, 0.0), ("s", 3, 10.6, 4.0, 1.0), ("s", 4, 11.0, None, 1.1), ("s", 5, 12.5, None, 1.1), ("s", 6, 12.6, 6.0, 1.1), ("s", 7, 12.7, 7.0, 1.15)]
    df = spark.createDataFrame([(s, f, int(t * 1e9), scale, 0.5, matrix(x)) for s, f, t, scale, x in data], "session_id string, frame bigint, stamp_ns bigint, scale double, offset double, m array<double>")
    for c in ("relative_w", "relative_h", "lidar_w", "lidar_h"):
        df = df.withColumn(c, F.lit(8))
    df = df.withColumns({"confidence_w": F.lit(None).cast("int"), "confidence_h": F.lit(None).cast("int")})
    got = rows(calibration.reuse_calibration(df, width=width).select("frame", "scale", "reused"))
    assert got == [(1, 2.0, False), (2, 2.0, True), (3, 4.0, False), (4, 4.0, True), (5, None, False), (6, 6.0, False), (7, 6.0, True)]


def test_top_and_trim_with_a_hot_session(spark):
    df = spark.range(100).select(F.lit("s").alias("session_id"), F.col("id").alias("vx"), F.lit(0).alias("vy"), F.lit(0).alias("vz"), (F.col("id") % 7).alias("updated_at"), (F.col("id") % 3 / 3.0).alias("confidence"))
    for limit in (None, 9):
        assert rows(points.trim_surfels(df, 20, limit=limit).select("vx")) == rows(df.orderBy(F.col("updated_at").desc(), "vx").limit(20).select("vx"))
        assert rows(points.top_surfels_per(df, 20, limit=limit).select("vx")) == rows(points.top_surfels(df, 20).select("vx"))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "double"])
def test_stretches_of_times_and_numbers(spark, log, kind):
    """The first order column may be a time, whose stretches are in nanoseconds, or a number."""
    frame = spark.createDataFrame(log, "k string, ts bigint, id bigint, v bigint, bytes bigint")
    ts = F.timestamp_seconds("ts").cast(kind) if kind != "double" else F.col("ts").cast(kind)
    timed = frame.withColumn("ts", ts)
    get = lambda w: rows(OrderedRows(timed, ["k"], ["ts", "id"], width=w).previous("b", "id").result().select("id", "b.id"))
    assert get(40 * 10**9 if kind != "double" else 40) == get(None)
