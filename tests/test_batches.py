"""Streams written batch by batch: reruns, late rows, order across batches, caps on live state."""

import pytest
from pyspark.sql import functions as F

from terralog.operators import gates, geo, points
from terralog.streaming import batches, stateful, stateless
from terralog.streaming.run import run_available
from tests.conftest import rows
from tests.test_streaming import stream_of  # noqa: F401

SECOND = 10**9
START = 1_700_000_000 * SECOND


@pytest.fixture
def broken_once(monkeypatch):
    """``put`` fails the first time that it is to write to a folder of this name, after a part of it is there."""
    done, put = set(), batches.put

    def fail(name):
        def once(frame, path, number, parts=()):
            if path.endswith(name) and name not in done:
                done.add(name)
                frame.limit(1).write.mode("overwrite").parquet(f"{path}/batch={number}/half")
                raise RuntimeError("lost between two writes")
            put(frame, path, number, parts)

        monkeypatch.setattr(batches, "put", once)

    return fail


def run_twice(make, state):
    """A run that breaks, and one that goes on from its checkpoint."""
    with pytest.raises(Exception, match="lost between two writes"):
        batches.run_writer(make(), state)
    batches.run_writer(make(), state)
    batches.run_writer(make(), state)  # nothing new


FIX, STATS = "sensor_msgs/msg/NavSatFix", "mapping_msgs/msg/PublisherStats"


def envelopes(n):
    out = []
    for k in range(n):
        if k % 5 == 4:
            data = "broken"
        elif k % 2:
            data = '{"op":"publish","msg":{"header":{"stamp":{"sec":%d}},"latitude":%s,"position_covariance":[1,2,3,4,5,6,7,8,9]}}' % (k, '"x"' if k % 3 == 0 else k)
        else:
            data = '{"op":"publish","msg":{"sent_messages":"%d","last_error":"e"}}' % k
        out.append((k, "/legacy/a" if k % 2 else "/mapping/b", FIX if k % 2 else STATS, k, data))
    return out


@pytest.mark.parametrize("where", ["converted", "mapping_msgs.msg.PublisherStats", "rejects"])
def test_a_rerun_batch_neither_doubles_rows_nor_rejects(spark, stream_of, broken_once, tmp_path, where):  # noqa: F811
    live, _ = stream_of(envelopes(40), "row_id bigint, topic string, type string, stamp_ns bigint, data string", 4)
    folder = str(tmp_path / "out")
    broken_once(where)
    run_twice(lambda: batches.land_converted(live, folder, [FIX, STATS]), str(tmp_path / "state"))
    fixes = batches.landed_types(spark, folder, FIX, "row_id bigint, ").collect()
    stats = batches.landed_types(spark, folder, STATS, "row_id bigint, ").collect()
    rejects = batches.landed_rejects(spark, folder, "row_id bigint, ").collect()
    good = [k for k in range(40) if k % 5 != 4]
    assert sorted(r.row_id for r in stats) == [k for k in good if k % 2 == 0] and all(int(r.message.sent_messages) == r.row_id for r in stats)
    assert sorted(r.row_id for r in fixes) == [k for k in good if k % 2 and k % 3] and all(r.message.latitude == r.row_id and len(r.message.position_covariance) == 9 for r in fixes)
    assert sorted(r.row_id for r in rejects) == [k for k in range(40) if k % 5 == 4 or (k % 2 and k % 3 == 0)]
    assert {r.reason for r in rejects} == {"payload is not JSON", f"fields do not fit {FIX}"}


def late_by_hand(data, files, delay):
    size, newest, late = -(-len(data) // files), None, []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        late += [r for r in part if newest is not None and r[2] < newest - delay]
        newest = max([r[2] for r in part] + ([newest] if newest is not None else []))
    return late


@pytest.mark.parametrize("where", ["rows", "clock"])
def test_late_rows_are_kept_aside(spark, stream_of, broken_once, tmp_path, where):  # noqa: F811
    data = [("s", "/t", START + (k * 60 - (900 if k % 7 == 3 else 0)) * SECOND, 10, k) for k in range(60)]
    live, stored = stream_of(data, "session_id string, topic string, stamp_ns bigint, bytes bigint, row_id bigint", 4)
    folder = str(tmp_path / "out")
    broken_once(where)
    run_twice(lambda: batches.split_late(live, folder, 300 * SECOND), str(tmp_path / "state"))
    late = late_by_hand(data, 4, 300 * SECOND)
    assert 3 <= len(late) < 9
    assert rows(batches.late_rows(spark, folder, stored.schema).select("row_id")) == sorted((r[4],) for r in late)
    on_time = batches.on_time_rows(spark, folder, stored.schema)
    rates = run_available(stateless.stream_topic_rates(on_time, "1 minute", watermark="5 minutes"), "rates")
    newest = max(r[2] for r in data)
    want = [r for r in data if r not in late and r[2] // (60 * SECOND) * 60 * SECOND + 60 * SECOND <= newest - 300 * SECOND]
    assert rates.agg(F.sum("messages")).first()[0] == len(want)


def test_an_empty_stream_has_no_late_rows(spark, stream_of, tmp_path):  # noqa: F811
    live, stored = stream_of([("s", 1)], "session_id string, stamp_ns bigint", 1)
    folder = str(tmp_path / "out")
    assert batches.late_rows(spark, folder, stored.schema).count() == 0
    batches.run_writer(batches.split_late(live.filter("stamp_ns > 5"), folder, 1), str(tmp_path / "state"))
    assert batches.late_rows(spark, folder, stored.schema).count() == 0


def test_gate_in_the_order_of_stamps(stream_of):  # noqa: F811
    data = [("ab"[k % 3 == 0], START + k * SECOND, k) for k in range(90)]
    arrived = sorted(data, key=lambda r: r[2] + r[2] % 4 * 5)
    live, stored = stream_of(arrived, "k string, ts bigint, id bigint", 5)
    got = run_available(stateful.stream_rate_gate(live, ["k"], 7 * SECOND, "ts", ["id"], watermark="20 seconds"), "t")
    want = gates.rate_gate(stored, ["k"], 7 * SECOND, stamp="ts", tie=["id"]).filter(F.col("ts") < START + 69 * SECOND)
    assert rows(got) == rows(want) and want.count() > 8


def test_origin_over_batches_out_of_order(stream_of):  # noqa: F811
    fix = [("s", k, START + k * SECOND, 39.0 + k * 1e-4, -104.0, 1600.0, 40.0 if k < 12 else 3.0) for k in range(60)]
    pose = [("s", k, START + (k * 4 + 6) * SECOND, float(k), 1.0, 2.0, 0.0, 0.0, 0.0, 1.0) for k in range(15)]
    live_fix, fixes = stream_of(sorted(fix, key=lambda r: r[1] + r[1] % 5 * 2), "session_id string, seq bigint, stamp_ns bigint, lat double, lon double, alt double, hacc double", 5)
    live_pose, poses = stream_of(sorted(pose, key=lambda r: r[1] * 4 + (r[1] % 2) * 8), "session_id string, seq bigint, stamp_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double", 5)
    got = {r["seq"]: r for r in run_available(stateful.stream_origin(live_fix, live_pose, watermark="25 seconds"), "o").collect()}
    newest = max(r[2] for r in fix + pose)
    want = {r["seq"]: r for r in geo.georeference(fixes, poses).collect() if r["stamp_ns"] < newest - 25 * SECOND}
    assert set(got) == set(want) and {w["reason"] for w in want.values()} == {None, "waiting_for_arkit_map_pose", "waiting_for_accurate_gps_origin"}
    for seq, w in want.items():
        assert got[seq]["reason"] == w["reason"]
        assert w["map"] is None or all(abs(got[seq]["map"][c] - w["map"][c]) < 1e-6 for c in "xyz")


def test_published_keys_are_not_forgotten_within_a_session(stream_of):  # noqa: F811
    day = 86_400 * SECOND
    data = [("s", START, 1, "a"), ("s", START + 1, 2, "b"), ("s", START + day, 3, "a"), ("t", START + day, 4, "a"), ("s", START + 2 * day, 6, "a"), ("s", START + 2 * day, 7, "a"), ("s", START + 2 * day, 8, None), ("s", START + 2 * day, 9, None)]
    live, _ = stream_of(data, "session_id string, stamp_ns bigint, seq bigint, dedup_key string", 4)
    starts, _ = stream_of([("u", START, 0), ("u", START, 0), ("s", START + 2 * day - 5, 5), ("u", START + 3 * day, 9)], "session_id string, stamp_ns bigint, seq bigint", 4)
    got = run_available(stateful.stream_unpublished(live, starts), "p")
    assert [r[2] for r in rows(got, "seq")] == [1, 2, 4, 6, 8]


def live_by_hand(parts, cap, voxel):
    """Snapshots after each batch: (cell) -> [observations, mean x, last stamp]."""
    live, out = {}, []
    for part in parts:
        for _, stamp, _, x, y, z, *_ in sorted(part, key=lambda r: r[1:3]):
            cell = tuple(int(v // voxel) for v in (x, y, z))
            n, mean, _ = live.get(cell, [0, 0.0, 0])
            w = min(n, 64)
            live[cell] = [n + 1, (mean * w + x) / (w + 1), stamp]
        kept = sorted(live, key=lambda c: (-live[c][2], c))[:cap]
        live = {c: live[c] for c in kept}
        out.append({c: list(v) for c, v in live.items()})
    return out


def test_the_cap_is_in_force_after_each_batch(spark, stream_of, tmp_path, broken_once):  # noqa: F811
    ddl = "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, r int, g int, b int, ox double, oy double, oz double"
    data = [("s", k, k, (k * 7 % 23) / 10, (k // 30 % 3) / 3, 0.1, k % 256, 5, 6, 1.0, float(k % 5), 3.0) for k in range(240)]
    live, stored = stream_of(data, ddl, 4)
    folder = str(tmp_path / "live")
    broken_once("live")
    run_twice(lambda: batches.keep_surfels(live, folder, 6, 0.5), str(tmp_path / "state"))
    want = live_by_hand([data[k : k + 60] for k in range(0, 240, 60)], 6, 0.5)
    schema = batches.surfel_schema(stored.schema, ["session_id"])
    assert batches.batch_numbers(spark, folder) == [0, 1, 2, 3]
    for k, expected in enumerate(want):
        got = {(r.vx, r.vy, r.vz): r for r in batches.live_surfels(spark, folder, schema, 0.5, at=k).collect()}
        assert set(got) == set(expected) and len(got) <= 6
        assert all((got[c].observation_count, got[c].updated_at) == (n, at) and abs(got[c].x - mean) < 1e-9 for c, (n, mean, at) in expected.items())
    assert any(n < sum(1 for r in data if (int(r[3] // 0.5), int(r[4] // 0.5), 0) == c) for c, (n, _, _) in want[-1].items())  # some began anew


def test_without_a_cap_live_surfels_are_those_of_the_batch_form(spark, stream_of, tmp_path):  # noqa: F811
    ddl = "session_id string, stamp_ns bigint, seq bigint, x double, y double, z double, r int, g int, b int, ox double, oy double, oz double"
    data = [("s", k, k, (k * 7 % 13) / 10, (k % 4) / 3, 0.1, k % 256, 5, 6, 1.0, float(k % 5), 3.0) for k in range(300)]
    live, stored = stream_of(data, ddl, 3)
    folder = str(tmp_path / "live")
    batches.run_writer(batches.keep_surfels(live, folder, None, 0.5), str(tmp_path / "state"))
    cell = ["session_id", "vx", "vy", "vz"]
    got = {tuple(r[c] for c in cell): r for r in batches.live_surfels(spark, folder, batches.surfel_schema(stored.schema, ["session_id"]), 0.5).collect()}
    want = {tuple(r[c] for c in cell): r for r in points.fuse_surfels(stored, 0.5).collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        assert (got[key]["observation_count"], got[key]["updated_at"], got[key]["r"]) == (w["observation_count"], w["updated_at"], w["r"])
        assert all(abs(got[key][c] - w[c]) < 1e-9 for c in ("x", "y", "z", "nx", "ny", "nz", "confidence", "radius"))
