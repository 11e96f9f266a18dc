"""Where the queries of this subpackage and their check SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskmill.session import Tables, apply_conf

# rows of an Arrow batch: texts are long, and a task holds a batch several times over
BATCH_ROWS = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bring a session to the settings the operators rely on."""
    apply_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with the SQL that checks it where there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            CHECK_SQL[name] = sql.strip()
        return fn

    return register
