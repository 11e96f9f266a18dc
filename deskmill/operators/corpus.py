"""Files of a knowledge base: exclusion, exact copies, titles, reports, manifests."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions.paths import exclude_reason
from deskmill.functions.text import base_name, classify_product, suffix, title_from_name
from deskmill.operators.chunking import kb_chunks
from deskmill.operators.ordered import newest

# File types whose text can be taken.
SUPPORTED = [".txt", ".md", ".docx", ".pdf", ".xlsx", ".xlsm"]
COPY_WORDS = ("копия",)
SOME_TEXT = r"(?U)\S"


def classify_files(files: DataFrame, rules: list[tuple[str, str]], supported: list[str] = SUPPORTED) -> DataFrame:
    """Add the exclusion ``reason`` and whether the type is ``supported``."""
    return files.withColumn("reason", exclude_reason(F.col("path"), rules)).withColumn(
        "supported", suffix(F.col("path")).isin(supported))


def canonical_copies(files: DataFrame, copy_words: tuple[str, ...] = COPY_WORDS) -> DataFrame:
    """Add ``canonical``: the path kept among files of equal content.

    Kept is the name without a copy mark, then the shortest, then the first one. The choice is a
    minimum, so a content that fills a third of all files is reduced before the shuffle.
    """
    name = F.lower(base_name(F.col("path")))
    marked = F.lit(False)
    for w in copy_words:
        marked = marked | F.contains(name, F.lit(w))
    best = F.min(F.struct(marked.alias("copy"), F.length(base_name(F.col("path"))).alias("size"), base_name(F.col("path")).alias("name"), "path"))
    kept = files.groupBy("digest").agg(best.alias("b"), F.count("*").alias("copies")).select("digest", F.col("b.path").alias("canonical"), "copies")
    return files.join(kept, "digest")


def with_digest(files: DataFrame) -> DataFrame:
    return files.withColumn("digest", F.sha2("text", 256))


def alias_titles(copies: DataFrame, copy_words: tuple[str, ...] = COPY_WORDS) -> DataFrame:
    """One row per canonical file and other title of its copies. Rows, not an array: their number has no bound."""
    named = copies.filter("path <> canonical").select("canonical", title_from_name(base_name(F.col("path")), copy_words).alias("alias")).distinct()
    own = title_from_name(base_name(F.col("canonical")), copy_words)
    return named.filter(F.col("alias") != own)


def knowledge_base(files: DataFrame, rules: list[tuple[str, str]], copy_words: tuple[str, ...] = COPY_WORDS, product_rules=None) -> dict[str, DataFrame]:
    """Documents, aliases, chunks and the outcome of every file of a folder.

    ``files`` may say in a column ``error`` that a file could not be read; such files and blank ones are no documents.
    """
    files = files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string"))
    seen = with_digest(classify_files(files, rules))
    usable = seen.filter(F.col("reason").isNull() & F.col("supported") & F.col("error").isNull())
    copies = canonical_copies(usable.select("doc_id", "path", "digest"), copy_words)
    kept = copies.filter("path = canonical").select("doc_id", "path", "digest")
    # title and product are told before the join, so that a reader who wants no text does not move it
    docs = usable.filter(F.col("text").rlike(SOME_TEXT)).withColumn("title", title_from_name(base_name(F.col("path")), copy_words))
    docs = docs.withColumn("product", classify_product(F.col("title"), F.col("text"), product_rules))
    docs = docs.join(kept.select("path"), "path", "left_semi")
    chunks = kb_chunks(docs, ["doc_id"])
    return {"seen": seen, "copies": copies, "documents": docs, "aliases": alias_titles(copies, copy_words), "chunks": chunks}


def file_outcomes(kb: dict[str, DataFrame]) -> DataFrame:
    """What became of each file: excluded, unsupported, failed, duplicate, empty or indexed, and its number of chunks."""
    outcome = (F.when(F.col("reason").isNotNull(), "excluded").when(~F.col("supported"), "unsupported")
               .when(F.col("error").isNotNull(), "failed").when(F.col("path") != F.col("canonical"), "duplicate")
               .when(~F.coalesce(F.col("text"), F.lit("")).rlike(SOME_TEXT), "empty").otherwise("indexed"))
    sizes = kb["chunks"].groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return (kb["seen"].join(kb["copies"].select("path", "canonical"), "path", "left").join(sizes, "doc_id", "left")
            .select("path", "canonical", F.coalesce("reason", "error").alias("reason"), outcome.alias("outcome"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")))


def build_report(outcomes: DataFrame, examples: int = 20) -> DataFrame:
    """Files and chunks per outcome with the first few paths."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_chunks").alias("chunks"))
    first = newest(outcomes, ["outcome"], examples, F.col("path")).groupBy("outcome").agg(
        F.array_join(F.sort_array(F.collect_list("path")), " | ").alias("examples"))
    return counts.join(first, "outcome")


def folder_signature(files: DataFrame, globs: list[str]) -> DataFrame:
    """Digest of names, sizes, times and rules that does not depend on the order of the scan.

    Each file's digest is cut into eight numbers that are summed, so no task sees all files.
    """
    line = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
    digest = F.sha1(line)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
    parts = files.select(digest.alias("d"), line.alias("line"), "path", "size", "mtime").agg(*sums, F.count("*").alias("n"))
    return parts.select(F.sha1(F.concat_ws("|", F.lit("|".join(globs)), F.col("n").cast("string"),
                                           *[F.col(f"s{i}").cast("string") for i in range(8)])).alias("signature"))


def manifest_diff(before: DataFrame, now: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """State of each (repo, path): new, changed, unchanged or removed.

    Repos that were not scanned this time are left as they are: their rows do not count as removed.
    """
    key = ["repo", "path"]
    scanned = (configured if configured is not None else now).select("repo").distinct()
    old = before.join(scanned, "repo", "left_semi").select(*key, F.struct("mtime", "size").alias("_old"))
    both = old.join(now.select(*key, F.struct("mtime", "size").alias("_new")), key, "full_outer")
    state = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed")
             .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed"))
    return both.select(*key, state.alias("state"))


def stale_sources(files: DataFrame, configured: DataFrame) -> DataFrame:
    return files.join(configured.select("repo").distinct(), "repo", "left_anti")


def list_documents(documents: DataFrame, chunks: DataFrame, product: str | None = None) -> DataFrame:
    """(path, title, product, n_chunks) by product and title, of one product or of all."""
    wanted = documents if product is None else documents.filter(F.col("product") == product)
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return wanted.join(sizes, "doc_id").select("path", "title", "product", "n_chunks").orderBy("product", "title", "path")


def index_health(spark: SparkSession, indexes: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(name, documents, ok, state) of each index, whose function reads its documents: ok, empty or unreadable.

    An index that cannot be opened or read is a row without a number, not an error.
    """
    def health(name, read):
        try:
            n = read().count()
        except (PySparkException, Py4JJavaError):
            return name, None, False, "unreadable"
        return name, n, n > 0, "ok" if n else "empty"

    return spark.createDataFrame([health(*x) for x in indexes.items()], "name string, documents long, ok boolean, state string")


def read_slice(chunks: DataFrame, doc_id: int, start: int = 0, count: int = 3, most: int = 10) -> DataFrame:
    """Chunks of one document from ``start``; an unknown document is an error."""
    doc = chunks.filter(F.col("doc_id") == doc_id)
    if doc.isEmpty():
        raise KeyError(doc_id)
    first = max(0, start)
    return doc.filter(F.col("chunk_no").between(first, first + max(1, min(count, most)) - 1)).orderBy("chunk_no")
