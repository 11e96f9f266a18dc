"""How well search answers: expected hits, metrics, question generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions.text import camel_words, first_comment


def unique_names(blocks: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs exactly once."""
    once = blocks.groupBy(name).agg(F.count("*").alias("_n")).filter("_n = 1").select(name)
    return blocks.join(once, name, "left_semi")


def expected_ranks(hits: DataFrame, expectations: DataFrame, fits: Column, questions: DataFrame) -> DataFrame:
    """(question_id, rank): place of the first hit that fits any of the question's expectations, null without one."""
    found = hits.join(expectations, "question_id").filter(fits).groupBy("question_id").agg(F.min("rank").alias("rank"))
    return questions.select("question_id").join(found, "question_id", "left")


def path_and_name_fit(path: str, name: str) -> Column:
    """An expected path is part of the hit's path, an expected name equals the hit's; an empty expectation always fits."""
    return (((F.col("expect_path") == "") | F.contains(F.col(path), F.col("expect_path")))
            & ((F.col("expect_name") == "") | (F.lower(F.col(name)) == F.lower("expect_name"))))


def metrics(ranks: DataFrame) -> DataFrame:
    """Share of questions with the first fitting hit at place 1, within 5, within 8, and the mean reciprocal rank."""
    def share(k):
        return F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0))

    return ranks.agg(F.count("*").alias("questions"), F.round(share(1), 6).alias("top1"), F.round(share(5), 6).alias("top5"),
                     F.round(share(8), 6).alias("top8"), F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))


def quality_gate(measured: DataFrame, least_top8: float) -> DataFrame:
    return measured.select("top8", (F.col("top8") >= least_top8).alias("passed"))


def question_pools(blocks: DataFrame, key: list[str], common_module: str = "ОбщийМодуль") -> DataFrame:
    """(pool, text, key…) out of procedures with unique names: by comment, by name in words, by call of an exported procedure."""
    unique = unique_names(blocks.filter(F.col("kind").isin("proc", "func")).withColumn("_low", F.lower("name")), "_low")
    phrase = first_comment(F.col("body"))
    spoken = camel_words(F.col("name"))
    n_words = F.size(F.filter(F.split(phrase, r"\s+"), lambda w: w != ""))
    asked = F.filter(F.array(
        F.when(n_words.between(4, 25), F.struct(F.lit(0).alias("pool"), F.concat(F.lit("какая процедура "), phrase, F.lit("?")).alias("text"))),
        F.when(F.size(spoken) >= 3, F.struct(F.lit(1).alias("pool"), F.concat(
            F.lit("где "), F.array_join(spoken, " "), F.lit(" ("), F.array_join(camel_words(F.col("object_name")), " "), F.lit(")")).alias("text"))),
        F.when(F.col("is_export") & (F.col("object_type") == common_module), F.struct(F.lit(2).alias("pool"), F.concat(
            F.lit("что делает "), "object_name", F.lit("."), "name").alias("text")))), lambda x: x.isNotNull())
    return unique.select(*key, "name", F.explode(asked).alias("q")).select("q.pool", "q.text", *key, "name")


def round_robin_pick(pools: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n questions taken from the shuffled pools in turn, no target twice. The shuffle is a seeded hash order."""
    shuffled = pools.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "pool", *[F.col(k).cast("string") for k in key])))
    once = shuffled.groupBy(*key).agg(F.min(F.struct("_h", "pool", "text")).alias("q")).select(*key, "q.*")
    # every map task keeps n rows per pool
    w = Window.partitionBy("pool").orderBy("_h")
    turns = once.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    return turns.orderBy("turn", "pool").limit(n).drop("_h")
