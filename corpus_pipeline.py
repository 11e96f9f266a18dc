"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import line_dedup, near_texts, packing, secret_scan, toxicity
from deskmill.llm.registry import prepare
from deskmill.session import Tables, materialise


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go."""
    prepare(spark)
    return toxicity.keep_clean(docs, Tables(spark, sf_dir).labels)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; every row stays, with what is left of its text."""
    prepare(spark)
    return _counted(line_dedup.drop_repeated_lines(docs)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest doc_id stays."""
    prepare(spark)
    return near_texts.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by their kind in brackets."""
    prepare(spark)
    found = secret_scan.find_secrets(docs, clean_col="_clean").withColumn("text", F.col("_clean"))
    return _counted(found).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_copies),
          ("secrets", redact_secrets), ("packing", pack)]

# Nearest neighbours, fingerprints and tokenizers have no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
