"""Run a stream over what is there now and read the result back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.session import scratch_path
from terralog.streaming.stateful import PROVIDER_CONF, ROCKSDB


def _settings(spark: SparkSession) -> dict[str, str]:
    wanted = {PROVIDER_CONF: ROCKSDB}
    if spark.sparkContext.master.startswith("local"):
        # a local run needs no more state stores than threads; a cluster keeps its own setting
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    return wanted


def run_available(stream: DataFrame, label: str, update_key: Sequence[str] | None = None) -> DataFrame:
    """Process all input, write to the shared folder, return the written rows.

    With ``update_key`` the stream gives update rows; each batch is written apart and the newest row per key counts.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    wanted = _settings(spark)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        if update_key is None:
            writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
        else:

            def write(batch: DataFrame, number: int) -> None:
                batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/{number}")

            writer = stream.writeStream.foreachBatch(write).outputMode("update")
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if update_key is None:
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    rest = [c for c in stream.columns if c not in update_key]
    return rows.groupBy(*update_key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*update_key, "_r.*")
