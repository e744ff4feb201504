"""A log landed in order: what readers may rely on, shown in their plans."""

import re

import pytest
from pyspark.sql import functions as F

from terralog.operators import joins, log, telemetry
from terralog.sources import bag
from tests.conftest import rows

SECOND = 10**9


@pytest.fixture
def landed(spark, tmp_path):
    """Half of the rows are of one session."""
    k = F.col("id")
    messages = spark.range(4000).select(
        F.when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (k % 7).cast("string"))).alias("session_id"), (k * 3 * SECOND).alias("stamp_ns"), k.alias("row_id"),
        F.when(k % 5 == 0, "/fix").otherwise("/pose").alias("topic"), (k % 100).alias("bytes"), (k % 3).alias("chunk"), F.lit("payload").alias("data"),
    )
    name = f"landed_{tmp_path.name.replace('-', '_')}"
    yield messages, bag.land_ordered(messages, name, str(tmp_path / "log"), 8, 600 * SECOND), str(tmp_path / "log")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def shuffled(df):
    """What lies below each exchange of the physical plan: the first aggregate, or a scan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    out = []
    for at, line in enumerate(lines):
        if re.search(r"\bExchange (hash|range|Single)", line):
            below = next(x for x in lines[at + 1 :] if re.search("Aggregate|FileScan|Window", x))
            out.append("Aggregate" if "Aggregate" in below else "Window" if "Window" in below else "FileScan")
    return out


def test_rows_are_not_shuffled(spark, landed):
    messages, table, path = landed
    asof = joins.asof_topics(table, "/fix", "/pose", ["row_id"], block="stretch")
    gaps = telemetry.staleness(table, ["session_id"], "stamp_ns", "row_id", 2.0, block="stretch")
    for plan in (asof, gaps, log.bag_summary(table)):
        assert "FileScan" not in shuffled(plan)
    plain = spark.read.parquet(path)  # the same files without their buckets
    assert "FileScan" in shuffled(telemetry.staleness(plain, ["session_id"], "stamp_ns", "row_id", 2.0, block="stretch"))
    assert rows(asof.select("session_id", "row_id", "right_row_id")) == rows(joins.asof_topics(messages, "/fix", "/pose", ["row_id"], width=None).select("session_id", "row_id", "right_row_id"))
    assert rows(gaps.select("row_id", "gap_s", "stale")) == rows(telemetry.staleness(messages, ["session_id"], "stamp_ns", "row_id", 2.0, width=None).select("row_id", "gap_s", "stale"))
    assert rows(log.bag_summary(table)) == rows(log.bag_summary(messages))


def test_a_hot_session_is_many_stretches_and_files_are_in_order(spark, landed):
    messages, table, path = landed
    sizes = table.groupBy("session_id", "stretch").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200 and sizes.filter("session_id = 'hot'").count() >= 20
    placed = spark.read.parquet(path).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    for file in {r.file for r in placed}:
        mine = [(r.session_id, r.stretch, r.stamp_ns, r.row_id) for r in sorted(placed, key=lambda r: r.at) if r.file == file]
        assert mine == sorted(mine)


def test_a_named_table_has_its_buckets(spark, landed):
    messages, _, path = landed
    name = "reopened_log"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        again = bag.open_ordered(spark, name, path, 8)
        assert "FileScan" not in shuffled(telemetry.staleness(again, ["session_id"], "stamp_ns", "row_id", 2.0, block="stretch")) and again.count() == 4000
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_as_of_within_a_tolerance(landed):
    messages, table, _ = landed
    near = joins.asof_topics(table, "/fix", "/pose", ["stamp_ns"], block="stretch", tolerance=3 * SECOND)
    assert near.filter("right_stamp_ns is not null and stamp_ns - right_stamp_ns > 3000000000").isEmpty() and near.count() == messages.filter("topic = '/fix'").count()
