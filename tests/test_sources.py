"""Chunk files, summaries, envelopes and artifacts on disk."""

import json

import pytest
from pyspark.sql import functions as F

from terralog.operators import gates, log, quality
from terralog.schemas import MESSAGE_DDL
from terralog.sources import artifacts, bag, envelopes
from tests.conftest import rows


SUMMARY = """rosbag2_bagfile_information:
  version: 8
  storage_identifier: sqlite3
  duration:
    nanoseconds: 30
  starting_time:
    nanoseconds_since_epoch: 10
  message_count: 4
  topics_with_message_count:
    - topic_metadata:
        name: '/mapping/gps/fix'
        type: 'sensor_msgs/msg/NavSatFix'
        serialization_format: 'rosbridge_json'
        offered_qos_profiles: ''
      message_count: 3
    - topic_metadata:
        name: '/it''s'
        type: 'std_msgs/msg/String'
        serialization_format: 'rosbridge_json'
        offered_qos_profiles: ''
      message_count: 1
  compression_format: ''
  compression_mode: ''
  relative_file_paths:
    - 'log_1.db3'
    - 'log_0.db3'
    - 'gone.db3'
  files:
    - path: 'log_0.db3'
      starting_time:
        nanoseconds_since_epoch: 10
      duration:
        nanoseconds: 20
      message_count: 3
    - path: 'log_1.db3'
      starting_time:
        nanoseconds_since_epoch: 40
      duration:
        nanoseconds: 0
      message_count: 1
  custom_data:
    serialization_format: 'rosbridge_json'
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "session_a"
    path.mkdir()
    for name in ("log_0.db3", "log_1.db3", "other.db3", "notes.txt"):
        (path / name).write_text("x")
    (path / "metadata.yaml").write_text(SUMMARY)
    return path


@pytest.fixture(scope="module")
def messages(spark):
    def envelope(topic, msg):
        return json.dumps({"op": "publish", "topic": topic, "msg": msg})

    fix, text = ("/mapping/gps/fix", "sensor_msgs/NavSatFix"), ("/it's", "std_msgs/msg/String")
    data = [
        ("session_a", "log_0.db3", 1, *fix, 10, envelope(fix[0], {"latitude": 1.5, "header": {"stamp": {"sec": 7, "nanosec": 9}}})),
        ("session_a", "log_0.db3", 2, *text, 30, envelope(text[0], {"data": "x"})),
        ("session_a", "log_0.db3", 3, *fix, 20, envelope(fix[0], {"latitude": 2.5})),
        ("session_a", "log_1.db3", 4, *fix, 40, "not json"),
    ]
    return spark.createDataFrame(data, MESSAGE_DDL)


def test_chunks_merge_in_time_order(messages):
    assert [tuple(r) for r in log.merge_chunks(messages).select("stamp_ns", "chunk", "row_id", "topic").collect()] == [
        (10, "log_0.db3", 1, "/mapping/gps/fix"), (20, "log_0.db3", 3, "/mapping/gps/fix"), (30, "log_0.db3", 2, "/it's"), (40, "log_1.db3", 4, "/mapping/gps/fix"),
    ]


def test_summary_documents(spark, folder, messages):
    session, topics, files = bag.read_bag_metadata(spark, str(folder / "metadata.yaml"))
    assert rows(session) == [("session_a", "sqlite3", 30, 10, 4)]
    assert rows(topics.select("position", "topic", "messages")) == [(0, "/mapping/gps/fix", 3), (1, "/it's", 1)]
    assert rows(files.select("path", "start_ns", "duration_ns", "messages")) == [("log_0.db3", 10, 20, 3), ("log_1.db3", 40, 0, 1)]
    found = log.bag_topics(messages)
    assert rows(quality.check_counts(topics, found).select("topic", "ok")) == [("/it's", True), ("/mapping/gps/fix", True)]


def test_summary_of_the_log_agrees(messages):
    got = log.bag_summary(messages).first()
    # the last written row of the first chunk is row 3 at 20, not the newest stamp
    assert (got["messages"], got["files"], got["start_ns"], got["end_ns"]) == (4, 2, 10, 40)
    assert rows(log.bag_files(messages).select("chunk", "end_ns")) == [("log_0.db3", 20), ("log_1.db3", 40)]


def test_conversion(spark, messages, tmp_path):
    renamed = log.rewrite_names(messages, "/legacy", "/mapping", "legacy_msgs", "mapping_msgs")
    decoded = log.decode_envelope(renamed)
    out = str(tmp_path / "typed")
    targets = envelopes.write_topics(decoded, out, ["sensor_msgs/msg/NavSatFix"])
    back = spark.read.parquet(targets[0])
    assert rows(back.select("session_id", "topic", "latitude", "stamp_ns")) == [("session_a", "/mapping/gps/fix", 1.5, 7_000_000_009), ("session_a", "/mapping/gps/fix", 2.5, 20)]
    with pytest.raises(Exception):
        envelopes.write_topics(decoded, out, ["sensor_msgs/msg/NavSatFix"])
    envelopes.write_topics(decoded, out, ["sensor_msgs/msg/NavSatFix"], force=True)
    assert log.envelope_rejects(renamed).count() == 1
    refused = [(r["topic"], r["reason"]) for r in spark.read.parquet(f"{out}/rejects").collect()]
    assert refused == [("/it's", "no schema for std_msgs/msg/String")]
    with pytest.raises(Exception):
        envelopes.write_topics(decoded, str(tmp_path / "strict"), ["sensor_msgs/msg/NavSatFix"], mode="fail")


def test_landing(spark, messages, tmp_path):
    out = str(tmp_path / "landed")
    bag.land_messages(messages, out)
    plan = log.select_topics(spark.read.parquet(out), ["/mapping/gps/fix"])
    assert plan.count() == 3 and "PartitionFilters: [topic" in plan._jdf.queryExecution().executedPlan().toString().replace("isnotnull(topic", "topic")


def test_sessions(spark, folder):
    got = bag.list_sessions(spark, str(folder.parent)).first()
    assert (got["session_id"], got["files"], got["chunks"], got["kinds"]) == ("session_a", 4, 3, ["chunk", "metadata"])


def test_envelope_lines(spark, tmp_path):
    path = tmp_path / "run7"
    path.mkdir()
    (path / "part.jsonl").write_text('{"op":"publish","topic":"/a","type":"t/T","msg":{"header":{"stamp":{"sec":3,"nanosec":4}}}}\n\n{"op":"publish","topic":"/b","msg":{}}\n')
    got = envelopes.read_envelopes(spark, str(path)).orderBy("topic").collect()
    assert [(r["session_id"], r["topic"], r["type"]) for r in got] == [("run7", "/a", "t/T"), ("run7", "/b", None)]
    assert got[0]["stamp_ns"] == 3_000_000_004 and got[1]["stamp_ns"] > 10**18
    stream = envelopes.stream_envelopes(spark, str(path), "s")
    assert stream.isStreaming and stream.columns == ["session_id", "topic", "type", "stamp_ns", "data"]


def test_rotation(spark):
    """Three messages over a 900 byte limit, two topics: three chunks, and ids in first-seen order."""
    df = spark.createDataFrame([("s", 1, "/mapping/status", 500), ("s", 2, "/mapping/pose", 600), ("s", 3, "/mapping/status", 500)], "session_id string, row_id bigint, topic string, bytes bigint")
    chunks = gates.assign_chunks(df, 900)
    assert rows(chunks.select("row_id", "chunk")) == [(1, 0), (2, 1), (3, 2)]
    assert rows(log.topic_ids(chunks).select("chunk", "topic_id", "topic")) == [(0, 1, "/mapping/status"), (1, 2, "/mapping/pose"), (2, 1, "/mapping/status")]


def read_parts(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_exports(spark, tmp_path):
    points = spark.createDataFrame([("s", 1, 0.25, 0.5, 0.75, 10, 20, 30), ("s", 0, float("nan"), 1.0, 2.0, 1, 2, 3)], "session_id string, seq bigint, x double, y double, z double, r int, g int, b int")
    artifacts.write_ply(points, str(tmp_path / "p.ply"))
    text = read_parts(tmp_path / "p.ply")
    assert text.startswith("ply\nformat ascii 1.0\n") and "element vertex 2\n" in text
    assert text.endswith("end_header\n0.000000 1.000000 2.000000 1 2 3\n0.250000 0.500000 0.750000 10 20 30\n")
    vertex = spark.createDataFrame([(1, i, float(i), 0.0, 0.5) for i in range(3)], "mesh_id bigint, vid bigint, x double, y double, z double")
    face = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 1, 7)], "mesh_id bigint, fid bigint, a bigint, b bigint, c bigint")
    artifacts.write_obj(vertex, face, str(tmp_path / "m.obj"))
    text = read_parts(tmp_path / "m.obj")
    assert "# triangle_count: 1\no final_overlay_mesh\nv 0.000000 0.000000 0.500000\n" in text and text.endswith("f 1 2 3\n")
    side = json.loads(artifacts.mesh_metadata(vertex, face, "s", "map", "now", {"k": "v"}).first()["value"])
    assert side["triangle_count"] == 1 and side["vertex_count"] == 3 and side["metadata"] == {"k": "v"} and list(side) == sorted(side)


def test_empty_cloud_header(spark):
    empty = spark.createDataFrame([], "seq bigint, x double, y double, z double, r int, g int, b int")
    assert "element vertex 0" in artifacts.ply_lines(empty, "seq", "s", "map", "").first()["value"]
    assert artifacts.pointcloud_metadata(empty.withColumn("k", F.lit(1)), "s", "map", "").count() == 1


def test_numbers_are_written_as_c_prints_them(spark):
    values = [3.6015625, -3.6015625, 3.6015635, -0.0, -1e-9, 1e6, float("inf"), 0.1, 12345.678]
    df = spark.createDataFrame([(i, v, 0.0, 0.0, 1, 1, 1) for i, v in enumerate(values)], "seq bigint, x double, y double, z double, r int, g int, b int")
    import struct

    got = [r["value"].split(" ")[0] for r in artifacts.ply_lines(df, "seq", "s", "map", "").filter("section = 1").orderBy("position").collect()]
    single = [struct.unpack("<f", struct.pack("<f", v))[0] for v in values]
    assert got == ["%.6f" % (0.0 if v == float("inf") else v) for v in single]
