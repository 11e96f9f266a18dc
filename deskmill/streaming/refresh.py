"""Refreshing a written index: only what changed is cut anew, and readers keep the old version meanwhile."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.operators.chunking import kb_chunks
from deskmill.operators.corpus import manifest_diff
from deskmill.session import materialise

KEY = ["repo", "path"]


class Versions:
    """Tables under a root in versions. A version holds only what is new in it and the keys that are gone with it (tombstones);
    it counts once its row is in the list of versions, so readers of an older one see what they saw.

    A row is alive in a version if no tombstone of its key is younger than the row and part of that version.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str] = KEY):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _list(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version int, whole boolean").parquet(f"{self.root}/current")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current(self) -> int | None:
        known = self._list()
        return None if known is None else known.agg(F.max("version")).first()[0]

    def parts(self, version: int) -> list[int]:
        """The versions that make up a version: the last whole one and those after it."""
        rows = self._list().filter(F.col("version") <= version).orderBy("version").collect()
        first = max(r.version for r in rows if r.whole)
        return [r.version for r in rows if r.version >= first]

    def _rows(self, name: str, versions: list[int]) -> DataFrame:
        # one read of all folders: the plan does not grow with the number of versions
        paths = [f"{self.root}/{name}/version={v}" for v in versions]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def read(self, name: str, version: int) -> DataFrame:
        versions = self.parts(version)
        rows = self._rows(name, versions)
        if len(versions) == 1:
            return rows.drop("version")
        gone = self._rows("gone", versions[1:]).groupBy(*self.key).agg(F.max("version").alias("gone"))
        alive = rows.join(gone, self.key, "left").filter(F.col("gone").isNull() | (F.col("gone") <= F.col("version")))
        return alive.select([c for c in rows.columns if c != "version"])

    def publish(self, tables: dict[str, DataFrame], gone: DataFrame | None = None) -> int:
        """A new version: rows that are added to the last one, whose rows of the keys ``gone`` end. Without ``gone`` it is whole."""
        version = (self.current() or 0) + 1
        for name, df in (tables if gone is None else {**tables, "gone": gone.select(*self.key).distinct()}).items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        (self.spark.range(1).select(F.lit(version).alias("version"), F.lit(gone is None).alias("whole"))
         .write.mode("append").parquet(f"{self.root}/current"))
        return version

    def compact(self, names: list[str]) -> int:
        """A whole version with the rows of the last one, so that reading it takes no tombstones."""
        now = self.current()
        return self.publish({n: self.read(n, now) for n in names})


MANY = 32  # versions after a whole one before they are put together


def refresh(versions: Versions, now: DataFrame) -> DataFrame:
    """Bring the index to the scanned files (repo, path, mtime, size, text); the result tells what happened to each file.

    Only new and changed files are cut and written, and the keys of changed and removed ones as tombstones.
    """
    manifest = now.select(*KEY, "mtime", "size")
    cut = [*KEY, "mtime", "size"]
    old = versions.current()
    if old is None:
        versions.publish({"files": manifest, "chunks": kb_chunks(now, cut)})
        return manifest.select(*KEY, F.lit("new").alias("state"))
    diff = materialise(manifest_diff(versions.read("files", old), manifest), "diff")
    dirty = diff.filter(F.col("state").isin("new", "changed")).select(*KEY)
    gone = diff.filter(F.col("state").isin("changed", "removed")).select(*KEY)
    if diff.filter(F.col("state") != "unchanged").isEmpty():
        return diff
    changed = now.join(dirty, KEY, "left_semi")
    versions.publish({"files": changed.select(*KEY, "mtime", "size"), "chunks": kb_chunks(changed, cut)}, gone)
    if len(versions.parts(versions.current())) > MANY:
        versions.compact(["files", "chunks"])
    return diff
