"""Sensor-log shaped views of the given tables.

The given tables hold no sensor log, so each view projects one of them to the columns an operator reads.  The SQL text
of the same view is beside it and is used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.functions.numeric import whole_div
from terralog.operators.ordered import OrderedRows
from terralog.session import freeze

SQL_VIEWS = {
    "S_msg": """
        SELECT user_id % 8 AS session_id, user_id AS source, '/' || event_type AS topic, epoch_us(ts) * 1000 AS stamp_ns,
               epoch_us(ts) * 1000 + (event_id % 1000) * 1000 AS recv_ns, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS bytes,
               event_id AS row_id, event_id // 2000 AS chunk
        FROM events""",
    "S_env": """
        SELECT user_id % 8 AS session_id, event_id AS row_id, '/record/' || event_type AS topic, epoch_us(ts) * 1000 AS stamp_ns,
               CASE event_id % 8
                 WHEN 0 THEN '{"op":"publish","topic":"/legacy/' || event_type || '","msg":{"header":{"stamp":{"sec":' || (event_id + 100) || ',"nanosec":' || (event_id * 7) || '}},"k":' || event_id || '}}'
                 WHEN 1 THEN '{"topic":"/legacyx/' || event_type || '","msg":{"transforms":[{"header":{"stamp":{"sec":' || event_id || ',"nanosec":5}}}]}}'
                 WHEN 2 THEN '{"op":null,"msg":{"k":' || event_id || '}}'
                 WHEN 3 THEN '{"op":"subscribe","topic":"/mapping/a","msg":{}}'
                 WHEN 4 THEN '{"op":"publish","topic":"/mapping/a","msg":"text"}'
                 WHEN 5 THEN '[1,2,3]'
                 WHEN 6 THEN '{"op":"publish"' || props
                 ELSE '{"op":"publish","topic":"","msg":{"k":' || event_id || '}}'
               END AS data
        FROM events""",
    "S_point": """
        SELECT l_suppkey % 8 AS session_id, l_orderkey AS frame, l_orderkey * 1000000 AS stamp_ns,
               (l_linenumber * 10000000 + l_partkey) * 20000000 + CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT) AS seq,
               l_quantity * 0.1e0 AS x, l_extendedprice / 20000e0 AS y, l_discount * 10e0 + 0e0 AS z,
               CAST(l_partkey % 256 AS BIGINT) AS r, CAST(l_suppkey % 256 AS BIGINT) AS g, CAST((l_partkey + l_suppkey) % 256 AS BIGINT) AS b
        FROM lineitem""",
    "S_fix": """
        SELECT CAST(c_nationkey AS BIGINT) AS session_id, c_custkey AS seq, 1700000000000000000 + c_custkey * 1000000000 AS stamp_ns,
               -80e0 + (c_custkey * 37 % 1600) / 10e0 AS lat, -180e0 + (c_custkey * 53 % 3600) / 10e0 AS lon, c_acctbal / 10e0 AS alt,
               CAST(c_custkey % 40 AS DOUBLE) AS hacc, CAST(c_custkey % 25 - 2 AS DOUBLE) AS vacc
        FROM customer""",
    "S_pose": """
        SELECT user_id % 25 AS session_id, event_id AS seq, 1700000000000000000 + event_id * 150000000 AS stamp_ns,
               value / 100e0 AS x, (event_id % 100) / 10e0 AS y, (event_id % 7) / 2e0 AS z,
               sin((event_id % 50) * 0.06e0) AS qy, cos((event_id % 50) * 0.06e0) AS qw
        FROM events WHERE event_type = 'view'""",
    "S_depth": """
        SELECT o_orderkey // 1024 AS frame, o_orderkey % 32 AS px, (o_orderkey // 32) % 32 AS py,
               0.1e0 + (o_custkey % 50) / 50e0 AS relative, 0.5e0 + 2e0 * (0.1e0 + (o_custkey % 50) / 50e0) + (o_orderkey % 7) * 0.01e0 AS depth,
               o_orderkey % 3 AS confidence
        FROM orders""",
    "S_radio": """
        SELECT user_id % 8 AS session_id, user_id AS source, event_type AS kind, event_id AS seq, epoch_us(ts) * 1000 AS stamp_ns,
               -30e0 - value / 10e0 AS rssi
        FROM events""",
    "S_send": """
        SELECT o_custkey % 16 AS session_id, o_orderkey AS seq, '/t' || (o_orderkey % 5) AS topic,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'retried' WHEN o_orderstatus = 'O' THEN 'sent'
                    WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'dropped' END AS kind,
               CASE WHEN o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' THEN o_orderpriority END AS error,
               epoch_us(o_orderdate) * 1000 AS ts_ns
        FROM orders""",
    "S_payload": """
        SELECT l_returnflag || l_linestatus AS stream, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq,
               CAST(floor(l_extendedprice + 0.5e0) AS BIGINT) - 2000 AS original_bytes, CAST(l_quantity AS BIGINT) * 1000 - 1500 AS encoded_bytes,
               'c' || (l_suppkey % 4) AS compression, epoch_us(l_shipdate) * 1000 AS ts_ns
        FROM lineitem""",
    "S_session": """
        SELECT conv_id AS session_id, conv_id * 1000 + turn AS seq, (1700000000 + conv_id * 100 + turn) * 1000000000 AS ts_ns,
               CASE role WHEN 'system' THEN 'started' WHEN 'user' THEN 'updated' ELSE 'stopped' END AS event,
               CASE role WHEN 'assistant' THEN 'idle' ELSE 'active' END AS state,
               CASE WHEN length(text) % 5 = 0 THEN 'error ' || (length(text) % 7) END AS last_error
        FROM conversations""",
    "S_attempt": """
        SELECT o_custkey AS request, o_orderkey AS position, o_orderpriority AS name, o_orderstatus = 'O' AS success,
               CASE WHEN o_orderstatus <> 'O' THEN 'code ' || (o_orderkey % 9) END AS error
        FROM orders""",
    "S_vertex": """
        SELECT l_orderkey // 64 AS mesh_id, row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS vid,
               l_quantity * 0.1e0 AS x, l_extendedprice / 20000e0 AS y, l_discount * 10e0 + 0e0 AS z
        FROM lineitem""",
    "S_face": """
        SELECT mesh_id, vid AS fid, CASE WHEN vid % 11 = 0 THEN -1 ELSE vid END AS a, (vid * 7 + 1) % 300 AS b, (vid * 3 + 2) % 280 AS c FROM S_vertex""",
}


class Tables:
    """The given tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # stamps of the given tables carry no zone; read them as UTC whatever the session says
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def msg(self) -> DataFrame:
        return messages(self.table("events"))

    def envelopes(self) -> DataFrame:
        e, t = F.col("event_id"), F.col("event_type")

        def text(*parts) -> Column:
            return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

        n = e.cast("string")
        data = (
            F.when(e % 8 == 0, text('{"op":"publish","topic":"/legacy/', t, '","msg":{"header":{"stamp":{"sec":', (e + 100).cast("string"), ',"nanosec":', (e * 7).cast("string"), '}},"k":', n, "}}"))
            .when(e % 8 == 1, text('{"topic":"/legacyx/', t, '","msg":{"transforms":[{"header":{"stamp":{"sec":', n, ',"nanosec":5}}}]}}'))
            .when(e % 8 == 2, text('{"op":null,"msg":{"k":', n, "}}"))
            .when(e % 8 == 3, F.lit('{"op":"subscribe","topic":"/mapping/a","msg":{}}'))
            .when(e % 8 == 4, F.lit('{"op":"publish","topic":"/mapping/a","msg":"text"}'))
            .when(e % 8 == 5, F.lit("[1,2,3]"))
            .when(e % 8 == 6, text('{"op":"publish"', F.col("props")))
            .otherwise(text('{"op":"publish","topic":"","msg":{"k":', n, "}}"))
        )
        return self.table("events").select(
            (F.col("user_id") % 8).alias("session_id"), e.alias("row_id"), F.concat(F.lit("/record/"), t).alias("topic"),
            nanos("ts").alias("stamp_ns"), data.alias("data"),
        )

    def points(self) -> DataFrame:
        c = F.col
        seq = (c("l_linenumber") * F.lit(10_000_000) + c("l_partkey")) * F.lit(20_000_000) + whole(c("l_extendedprice") * 100)
        return self.table("lineitem").select(
            (c("l_suppkey") % 8).alias("session_id"), c("l_orderkey").alias("frame"), (c("l_orderkey") * 1_000_000).alias("stamp_ns"), seq.alias("seq"),
            (c("l_quantity") * F.lit(0.1)).alias("x"), (c("l_extendedprice") / F.lit(20000.0)).alias("y"), (c("l_discount") * F.lit(10.0) + F.lit(0.0)).alias("z"),
            (c("l_partkey") % 256).alias("r"), (c("l_suppkey") % 256).alias("g"), ((c("l_partkey") + c("l_suppkey")) % 256).alias("b"),
        )

    def fixes(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.col("c_nationkey").cast("bigint").alias("session_id"), k.alias("seq"), (F.lit(1_700_000_000_000_000_000) + k * 1_000_000_000).alias("stamp_ns"),
            (F.lit(-80.0) + (k * 37 % 1600) / F.lit(10.0)).alias("lat"), (F.lit(-180.0) + (k * 53 % 3600) / F.lit(10.0)).alias("lon"),
            (F.col("c_acctbal") / F.lit(10.0)).alias("alt"), (k % 40).cast("double").alias("hacc"), (k % 25 - 2).cast("double").alias("vacc"),
        )

    def poses(self) -> DataFrame:
        return poses(self.table("events"))

    def depth(self) -> DataFrame:
        o, relative = F.col("o_orderkey"), F.lit(0.1) + (F.col("o_custkey") % 50) / F.lit(50.0)
        return self.table("orders").select(
            whole_div(o, 1024).alias("frame"), (o % 32).alias("px"), (whole_div(o, 32) % 32).alias("py"), relative.alias("relative"),
            (F.lit(0.5) + F.lit(2.0) * relative + (o % 7) * F.lit(0.01)).alias("depth"), (o % 3).alias("confidence"),
        )

    def intrinsics(self) -> DataFrame:
        """One camera per depth frame."""
        f = F.col("frame")
        one, zero = F.lit(1.0), F.lit(0.0)
        m = F.array(zero, zero, one, f.cast("double"), zero, one, zero, F.lit(2.0), -one, zero, zero, F.lit(3.0), zero, zero, zero, one)
        return self.table("orders").select(whole_div(F.col("o_orderkey"), 1024).alias("frame")).distinct().select(
            "frame", F.lit(600.0).alias("fx"), F.lit(590.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"),
            F.lit(640).alias("image_w"), F.lit(480).alias("image_h"), F.lit(32).alias("depth_w"), F.lit(32).alias("depth_h"), m.alias("m"),
        )

    def radio(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") % 8).alias("session_id"), F.col("user_id").alias("source"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"),
            nanos("ts").alias("stamp_ns"), (F.lit(-30.0) - F.col("value") / F.lit(10.0)).alias("rssi"),
        )

    def sends(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        kind = F.when(priority == "1-URGENT", "retried").when(status == "O", "sent").when(status == "F", "failed").otherwise("dropped")
        return self.table("orders").select(
            (F.col("o_custkey") % 16).alias("session_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("/t"), (F.col("o_orderkey") % 5).cast("string")).alias("topic"),
            kind.alias("kind"), F.when((status != "O") & (priority != "5-LOW"), priority).alias("error"), nanos("o_orderdate").alias("ts_ns"),
        )

    def payloads(self) -> DataFrame:
        return payloads(self.table("lineitem"))

    def session_events(self) -> DataFrame:
        return session_events(self.table("conversations"))

    def attempts(self) -> DataFrame:
        o = F.col("o_orderkey")
        failed = F.col("o_orderstatus") != "O"
        return self.table("orders").select(
            F.col("o_custkey").alias("request"), o.alias("position"), F.col("o_orderpriority").alias("name"), (~failed).alias("success"),
            F.when(failed, F.concat(F.lit("code "), (o % 9).cast("string"))).alias("error"),
        )

    def vertices(self) -> DataFrame:
        """Mesh of 64 orders each; every row is a vertex, numbered within its mesh.  Mesh operators read their vertices
        several times, so the table is written once, as a landed one would be."""
        base = self.table("lineitem").withColumn("mesh_id", whole_div(F.col("l_orderkey"), 64))
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        needed = base.select("mesh_id", *order, "l_quantity", "l_discount")
        numbered = OrderedRows(needed, ["mesh_id"], order).rank("vid").result().select(
            "mesh_id", (F.col("vid") - 1).alias("vid"), (F.col("l_quantity") * F.lit(0.1)).alias("x"),
            (F.col("l_extendedprice") / F.lit(20000.0)).alias("y"), (F.col("l_discount") * F.lit(10.0) + F.lit(0.0)).alias("z"),
        )
        return freeze(numbered)

    def faces(self, vertex: DataFrame) -> DataFrame:
        """One triangle per vertex; some point past the end of their mesh."""
        v = F.col("vid")
        return vertex.select("mesh_id", v.alias("fid"), F.when(v % 11 == 0, -1).otherwise(v).cast("bigint").alias("a"), ((v * 7 + 1) % 300).alias("b"), ((v * 3 + 2) % 280).alias("c"))


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def whole(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def messages(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 8).alias("session_id"), F.col("user_id").alias("source"), F.concat(F.lit("/"), "event_type").alias("topic"),
        nanos("ts").alias("stamp_ns"), (nanos("ts") + (F.col("event_id") % 1000) * 1000).alias("recv_ns"), whole(F.col("value") * 100).alias("bytes"),
        F.col("event_id").alias("row_id"), whole_div(F.col("event_id"), 2000).alias("chunk"),
    )


def poses(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    half = (e % 50) * F.lit(0.06)
    return events.filter("event_type = 'view'").select(
        (F.col("user_id") % 25).alias("session_id"), e.alias("seq"), (F.lit(1_700_000_000_000_000_000) + e * 150_000_000).alias("stamp_ns"),
        (F.col("value") / F.lit(100.0)).alias("x"), ((e % 100) / F.lit(10.0)).alias("y"), ((e % 7) / F.lit(2.0)).alias("z"),
        F.lit(0.0).alias("qx"), F.sin(half).alias("qy"), F.lit(0.0).alias("qz"), F.cos(half).alias("qw"),
    )


def payloads(lineitem: DataFrame) -> DataFrame:
    c = F.col
    return lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("stream"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 1_000_000 + c("l_partkey")).alias("seq"),
        (whole(c("l_extendedprice")) - 2000).alias("original_bytes"), (c("l_quantity").cast("bigint") * 1000 - 1500).alias("encoded_bytes"),
        F.concat(F.lit("c"), (c("l_suppkey") % 4).cast("string")).alias("compression"), nanos("l_shipdate").alias("ts_ns"),
    )


def session_events(conversations: DataFrame) -> DataFrame:
    role, size = F.col("role"), F.length("text")
    return conversations.select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        ((F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")) * 1_000_000_000).alias("ts_ns"),
        F.when(role == "system", "started").when(role == "user", "updated").otherwise("stopped").alias("event"),
        F.when(role == "assistant", "idle").otherwise("active").alias("state"),
        F.array(F.lit("pose"), F.when(F.col("turn") % 2 == 0, F.lit("gps")).otherwise(F.lit("camera"))).alias("enabled_streams"),
        F.when(size % 5 == 0, F.concat(F.lit("error "), (size % 7).cast("string"))).alias("last_error"),
    )
