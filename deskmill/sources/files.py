"""Folders of files: scan, decode, text extraction."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, suffixes: dict[str, str]) -> DataFrame:
    """Relative path, modification time, size and kind of all files with a known suffix.

    Contents are not read. Hidden folders are passed over; files that vanish or cannot be read are skipped.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(folder))
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", rf"^[a-z0-9]+:/*\Q{root}\E/", "")
    kind = F.lit(None).cast("string")
    for suffix, name in suffixes.items():
        kind = F.when(F.lower(rel).endswith(suffix), name).otherwise(kind)
    return (found.select("path", rel.alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), kind.alias("kind"))
            .filter(F.col("kind").isNotNull() & ~F.col("rel_path").rlike(r"(^|/)\.[^/]*/")))


def decode_text(content: Column) -> Column:
    """UTF-8 (a byte order mark is dropped), else Windows-1251; line ends become newlines."""
    upper = bytes(range(0x80, 0x100))
    text = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(
        F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode("cp1251", errors="replace")))
    return F.regexp_replace(text, r"\r\n?", "\n")


def _docx(data: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p"))


def _pdf(data: bytes) -> str:
    from pypdf import PdfReader

    def text(page) -> str:
        try:
            return page.extract_text() or ""
        except Exception:  # noqa: BLE001  a bad page leaves the others
            return ""

    return "\n".join(text(page) for page in PdfReader(io.BytesIO(data)).pages)


def _xlsx(data: bytes) -> str:
    from openpyxl import load_workbook
    book = load_workbook(io.BytesIO(data), read_only=True, data_only=True)
    lines = []
    for sheet in book:
        lines.append(f"# Лист: {sheet.title}")
        lines += [" | ".join(str(c) for c in row if c is not None) for row in sheet.iter_rows(values_only=True)]
    return "\n".join(lines)


def _plain(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


READERS = {".txt": _plain, ".md": _plain, ".docx": _docx, ".pdf": _pdf, ".xlsx": _xlsx, ".xlsm": _xlsx}


def extract_text(files: DataFrame) -> DataFrame:
    """(path, text, error) of files given as (path, content). A file that cannot be read has an error and stops nothing."""

    def read(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                suffix = "." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
                try:
                    out.append((path, READERS[suffix](bytes(content)), None))
                except Exception as exc:  # noqa: BLE001
                    out.append((path, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")


def read_contents(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
            .load(folder).select("path", "content"))
