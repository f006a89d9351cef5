"""Directories of documents as raw documents."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# File types by suffix.
TYPES = {".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".txt": "txt", ".pdf": "pdf"}


class SourceError(ValueError):
    """A source that may not or can not be read; the code comes first in the message."""


@dataclass(frozen=True)
class Scan:
    """What a directory scan passes over."""

    recursive: bool = True
    # What a scan leaves out by default.
    ignored_dirs: tuple[str, ...] = (".git", ".idea", "__pycache__", ".tmp_tests")
    ignored_paths: tuple[str, ...] = ("data/indexes",)
    skip_hidden: bool = True
    temporary_prefixes: tuple[str, ...] = ("~$",)
    temporary_suffixes: tuple[str, ...] = (".tmp", ".part", ".crdownload")
    suffixes: tuple[str, ...] = field(default_factory=lambda: tuple(TYPES))
    #: Whether one bad file ends a build; else it is a row of failures.
    fail_fast: bool = False

    def wanted(self, rel: Column) -> Column:
        """Whether the file at a relative path is a document of the scan."""
        parts = F.split(rel, "/")
        name, low = F.lower(F.element_at(parts, -1)), F.lower(rel)
        skip = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*self.ignored_dirs))
        if self.skip_hidden:
            skip = skip | F.exists(parts, lambda p: p.startswith("."))
        for path in filter(None, (p.strip("/").lower() for p in self.ignored_paths)):
            skip = skip | (low == path) | low.startswith(path + "/")
        for p in self.temporary_prefixes:
            skip = skip | name.startswith(p)
        for s in self.temporary_suffixes:
            skip = skip | name.endswith(s)
        return ~skip & F.lower(suffix(rel)).isin(*self.suffixes)


def suffix(path: Column) -> Column:
    """The last suffix of a path's name, dot included, or ''."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1)


def allowed_directory(path: str, roots: list[str]) -> str:
    """A local directory's real path, if it is readable and under one of the roots. Paths with a scheme are
    compared as they are."""
    if "://" in path:
        if not any(path.rstrip("/") == r.rstrip("/") or path.startswith(r.rstrip("/") + "/") for r in roots):
            raise SourceError(f"INVALID_SOURCE: {path} is not under an allowed root")
        return path
    real = Path(path).resolve()
    if not real.is_dir():
        raise SourceError(f"DOCUMENT_LOAD_FAILED: {path} is no directory")
    if not os.access(real, os.R_OK):
        raise SourceError(f"DOCUMENT_LOAD_FAILED: {path} can't be read")
    if not any(real.is_relative_to(Path(r).resolve()) for r in roots):
        raise SourceError(f"INVALID_SOURCE: {path} is not under an allowed root")
    return str(real)


def load(spark: SparkSession, directory: str, scan: Scan = Scan()) -> tuple[DataFrame, DataFrame]:
    """(raw documents, failures) of a directory, any store that Spark reads included. Files that are no
    valid UTF-8 where they should be are failures of their own."""
    if "://" not in directory:
        if not Path(directory).is_dir():
            raise SourceError(f"DOCUMENT_LOAD_FAILED: {directory} is no directory")
        directory = "file://" + str(Path(directory).resolve())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(scan.recursive).lower())
    files = reader.load(directory)
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    root = "/" + directory.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring(bare(F.col("path")), len(root) + 1, 1 << 30)
    rows = files.withColumn("rel", rel).where(scan.wanted(F.col("rel")))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.lower(suffix(F.col("rel"))))
    rows = rows.select("rel", bare(F.col("path")).alias("source_path"), kind.alias("file_type"), "content", F.col("length").alias("file_size"), F.element_at(F.split("rel", "/"), -1).alias("filename"))
    valid = (F.col("file_type") == "pdf") | F.call_function("is_valid_utf8", F.col("content").cast("string"))
    doc_id, hashed = T.document_id(F.col("source_path")), T.content_hash(F.col("content"))
    raw = rows.where(valid).withColumns({"doc_id": doc_id, "content_hash": hashed})
    text = F.when(F.col("file_type") != "pdf", F.col("content").cast("string"))
    raw = raw.select("doc_id", T.version_id(F.col("doc_id"), F.col("content_hash")).alias("version_id"), "content_hash", "source_path", "file_type", "filename", "file_size", text.alias("raw_text"), "content")
    fails = rows.where(~valid).select("source_path", F.lit("loading").alias("stage"), F.lit("DOCUMENT_LOAD_FAILED").alias("error_code"), F.lit("the file is no valid UTF-8").alias("error_message"))
    return raw, fails


def totals(raw: DataFrame, parsed: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: candidates, succeeded, failed."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    one = n(parsed, "succeeded").crossJoin(n(failures, "failed"))  # two rows of one
    return one.select((F.col("succeeded") + F.col("failed")).alias("candidates"), "succeeded", "failed")
