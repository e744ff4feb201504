"""Streams fed file by file give what the batch operators give."""

import os

import pytest
from pyspark.sql import functions as F

from terralog.operators import gates, geo, points
from terralog.operators.log import envelope_rejects
from terralog.streaming import stateful, stateless
from terralog.streaming.run import run_available
from tests.conftest import rows


@pytest.fixture()
def stream_of(spark, tmp_path):
    """Rows as a stream of several files, one per micro-batch, in the given order."""
    count = [0]

    def make(data, ddl, files=3):
        count[0] += 1
        folder = tmp_path / f"in{count[0]}"
        size = -(-len(data) // files)
        for i in range(files):
            part = spark.createDataFrame(data[i * size : (i + 1) * size], ddl)
            part.coalesce(1).write.mode("append").parquet(str(folder))
            for f in folder.glob("part-*"):
                if f.stat().st_mtime > 1_000_000_100:
                    os.utime(f, (1_000_000_000 + i, 1_000_000_000 + i))
        return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(folder)), spark.createDataFrame(data, ddl)

    return make


def test_rate_gate(stream_of):
    data = [("ab"[i % 3 == 0], i * 3 + i % 2, i) for i in range(60)]
    live, stored = stream_of(data, "k string, ts bigint, id bigint")
    got = run_available(stateful.stream_rate_gate(live, ["k"], 10, "ts", ["id"]), "t")
    assert rows(got) == rows(gates.rate_gate(stored, ["k"], 10, stamp="ts", tie=["id"]))


def test_voxels_and_surfels(stream_of):
    ddl = "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, r int, g int, b int, ox double, oy double, oz double"
    data = [("s", i, i, (i * 7 % 13) / 10, (i % 4) / 3, 0.1, i % 256, 5, 6, 1.0, float(i % 5), 3.0) for i in range(90)]
    live, stored = stream_of(data, ddl)
    first = run_available(stateful.stream_voxels(live, 0.5), "v")
    assert rows(first.select("seq")) == rows(points.voxel_filter(stored, 0.5, ["stamp_ns", "seq"], ["session_id"]).select("seq"))
    cell = ["session_id", "vx", "vy", "vz"]
    fused = run_available(stateful.stream_surfels(live, 0.5), "u", cell)
    want = {tuple(r[c] for c in cell): r for r in points.fuse_surfels(stored, 0.5).collect()}
    got = {tuple(r[c] for c in cell): r for r in fused.collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        assert (g["observation_count"], g["updated_at"], g["r"]) == (w["observation_count"], w["updated_at"], w["r"])
        assert all(abs(g[c] - w[c]) < 1e-9 for c in ("x", "y", "z", "nx", "ny", "nz", "confidence", "radius"))


def test_staleness_is_told_once(stream_of):
    second = 10**9
    stamps = [0, 5, 8, 30, 31, 60, 62, 64, 100]
    data = [("s", 1_700_000_000 * second + t * second) for t in stamps] + [("other", 1_700_000_000 * second + t * second) for t in (0, 200, 201)]
    data.sort(key=lambda r: r[1])
    live, _ = stream_of(data, "session_id string, stamp_ns bigint", 4)
    got = run_available(stateful.stream_staleness(live, 10.0), "st")
    assert sorted((r["session_id"], r["last_ns"] // second - 1_700_000_000) for r in got.collect()) == [("other", 0), ("s", 8), ("s", 31), ("s", 64), ("s", 100)]


def test_origin(stream_of):
    fix = [("s", i, i * 100, 39.0 + i * 1e-4, -104.0, 1600.0, 40.0 if i < 4 else 3.0) for i in range(9)]
    pose = [("s", i, 150 + i * 200, float(i), 1.0, 2.0, 0.0, 0.0, 0.0, 1.0) for i in range(4)]
    # both streams end within one batch, so that no batch border reorders them
    live_fix, fixes = stream_of(fix, "session_id string, seq bigint, stamp_ns bigint, lat double, lon double, alt double, hacc double", 1)
    live_pose, poses = stream_of(pose, "session_id string, seq bigint, stamp_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double", 1)
    got = {r["seq"]: r for r in run_available(stateful.stream_origin(live_fix, live_pose), "o").collect()}
    want = {r["seq"]: r for r in geo.georeference(fixes, poses).collect()}
    assert set(got) == set(want) and {w["reason"] for w in want.values()} == {None, "waiting_for_arkit_map_pose", "waiting_for_accurate_gps_origin"}
    for seq, w in want.items():
        assert got[seq]["reason"] == w["reason"]
        assert (got[seq]["map"] is None) == (w["map"] is None)
        assert w["map"] is None or all(abs(got[seq]["map"][c] - w["map"][c]) < 1e-6 for c in "xyz")


def test_decode_leaves_bad_rows_out(stream_of):
    data = [("s", "/t", i, '{"op":"publish","msg":{"k":1}}' if i % 2 else "oops") for i in range(10)]
    live, stored = stream_of(data, "session_id string, topic string, stamp_ns bigint, data string")
    assert run_available(stateless.stream_decode(live), "d").count() == 5 and envelope_rejects(stored).count() == 5


def test_windows_close_behind_the_watermark(stream_of):
    minute = 60 * 10**9
    data = [("s", "/t", 1_700_000_040 * 10**9 + i * minute // 2, 100) for i in range(40)]
    live, _ = stream_of(data, "session_id string, topic string, stamp_ns bigint, bytes bigint", 4)
    got = run_available(stateless.stream_topic_rates(live, "1 minute", watermark="2 minutes"), "w")
    assert {(r["messages"], r["bytes"], r["mbps"] > 0) for r in got.collect()} == {(2, 200, True)} and got.count() == 17


def test_gap_sessions(stream_of):
    data = [(7, 1_700_000_000 * 10**9 + t * 10**9) for t in (0, 5, 9, 100, 104, 900)]
    live, _ = stream_of(data, "source bigint, stamp_ns bigint", 2)
    got = run_available(stateless.stream_gap_sessions(live, "30 seconds", "1 minute"), "g")
    assert sorted(r["messages"] for r in got.collect()) == [2, 3]


def test_dedup(stream_of):
    data = [(f"k{i % 7}", 1_700_000_000 * 10**9 + i * 10**9) for i in range(30)]
    live, stored = stream_of(data, "dedup_key string, stamp_ns bigint")
    assert rows(run_available(stateless.stream_dedup(live).select("dedup_key"), "x")) == rows(stored.select("dedup_key").distinct())
