"""Tables that are kept between calls."""

from pyspark.sql import functions as F

from deskmill.session import kept, workspace


def test_kept_until_a_file_changes(spark):
    path, calls = workspace(spark, "source"), []
    spark.range(10).coalesce(1).write.parquet(path)

    def total():
        source = spark.read.parquet(path)

        def build(write):
            calls.append(1)
            write("sums", source.agg(F.sum("id").alias("s")))
            write("rows", source.select((F.col("id") * 2).alias("twice")))

        tables = kept(source, "totals", build)
        return tables["sums"].first()[0], tables["rows"].count()

    assert [total(), total()] == [(45, 10)] * 2 and len(calls) == 1
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(path)
    assert [total(), total()] == [(66, 12)] * 2 and len(calls) == 2


def test_a_build_that_fails_leaves_nothing(spark):
    path = workspace(spark, "source")
    spark.range(3).write.parquet(path)
    source = spark.read.parquet(path)

    def broken(write):
        write("a", source)
        write("b", source.select(F.raise_error(F.lit("no")).alias("x")))

    try:
        kept(source, "broken", broken)
    except Exception as e:  # noqa: BLE001
        assert "no" in str(e)
    assert kept(source, "broken", lambda write: write("a", source))["a"].count() == 3
