"""Session settings, the table reader and the shared work folder."""

from __future__ import annotations

import json
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings that results depend on, plus the ones skewed data depends on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text work costs much per byte, so small shuffles may stay spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets "row_number() <= n" cut every map task to n rows per group before the shuffle, whatever n is
    "spark.sql.optimizer.windowGroupLimitThreshold": str((1 << 31) - 1),
}


def build_session(app: str = "deskmill", master: str | None = None, partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Bring a session that somebody else built to the settings the operators rely on."""
    # Python workers get this package's functions with the task, they need not have it installed
    cloudpickle.register_pickle_by_value(sys.modules["deskmill"])
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables.

    It is ``spark.checkpoint.dir``, which all executors share. Where that is unset, a temporary folder takes its place, but only
    in local mode, where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="deskmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_state(source: DataFrame) -> str:
    """Tells the state of the files a frame is read from by their names, sizes and times: equal as long as no file changes."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = source.select(file.alias("f")).distinct()
    n, total = files.agg(F.count("*"), F.sum(F.pmod("f", F.lit(1 << 40)))).first()
    return f"{n}-{total or 0:x}"


def kept(source: DataFrame, name: str, build: Callable[[Callable[[str, DataFrame], DataFrame]], None]) -> dict[str, DataFrame]:
    """Tables derived from a frame's files, built when they are first asked for and read back as long as the files stay.

    ``build`` gets a function that writes a table under a name and gives it back as read from there. The tables lie below the
    shared root, so other sessions find them too. A build goes to a folder of its own and counts only once rows that name its
    tables are written; of builds that ran side by side all readers take the same one.
    """
    spark = source.sparkSession
    entry = f"{shared_root(spark)}/kept-{name}-{file_state(source)}"

    def found() -> list:
        try:
            return spark.read.schema("folder string, name string, kind string").parquet(entry).orderBy("folder").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    rows = found()
    if not rows:
        folder, made = workspace(spark, name), []

        def write(table: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{folder}/{table}")
            made.append((folder, table, df.schema.json()))
            return spark.read.schema(df.schema).parquet(f"{folder}/{table}")

        build(write)
        spark.createDataFrame(made, "folder string, name string, kind string").coalesce(1).write.mode("append").parquet(entry)
        rows = found()
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.kind))).parquet(f"{r.folder}/{r.name}")
            for r in rows if r.folder == rows[0].folder}


class Tables:
    """The parquet tables of one folder, read lazily by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
