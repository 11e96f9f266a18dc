"""Running a streaming query over what is there, and reading its output."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.session import ROCKSDB, workspace


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """Key-value state store; ``partitions`` sets the number of state partitions, which a checkpoint keeps for good."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, schema, ts: str = "ts", delay: str = "10 minutes", files_per_batch: int | None = None,
                heartbeat: DataFrame | None = None) -> DataFrame:
    """File stream with an event-time column of the zoned type and a watermark on it.

    ``heartbeat`` has rows of a key that nothing else uses. They arrive beside the stream and take the watermark on, so that a
    run over a finished folder closes all that a silent source would leave open; they stay behind the watermark themselves.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    if heartbeat is not None:
        beats = workspace(spark, "heartbeat")
        heartbeat.select(*stream.columns).write.parquet(beats)
        stream = stream.unionByName(spark.readStream.schema(schema).parquet(beats))
    return stream.withColumn(ts, stream[ts].cast("timestamp")).withWatermark(ts, delay)


def heartbeat(table: DataFrame, key: str, value, ts: str = "ts", after: str = "30 days") -> DataFrame:
    """One row like the table's newest, of the key ``value``, long after it; none for an empty table."""
    newest = table.agg(F.max_by(F.struct(*table.columns), ts).alias("r")).filter("r is not null").select("r.*")
    return newest.withColumn(key, F.lit(value).cast(table.schema[key].dataType)).withColumn(ts, F.expr(f"{ts} + interval {after}"))


def run_available(stream: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Process everything that is there into a table, and read the table."""
    spark = stream.sparkSession
    out, state = workspace(spark, name), workspace(spark, f"{name}-state")
    with state_settings(spark, partitions):
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_versions(stream: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Keep the whole (small) result of an aggregation current: each micro-batch writes a version, the last one is read."""
    spark = stream.sparkSession
    out, state = workspace(spark, name), workspace(spark, f"{name}-state")
    done: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/version={batch}")
        done.append(batch)

    with state_settings(spark, partitions):
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
             .outputMode("complete").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/version={max(done)}")
