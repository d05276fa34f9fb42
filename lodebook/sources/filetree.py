"""A file tree as a table, read in parallel.

Spark's own file sources leave out names that start with a dot or an underscore
(`__init__.py` among them), so the tree is read through the Python data source API:
the listing (names and sizes only) is cut into byte-balanced partitions, and the
contents are read by the tasks. The root has to be visible to all executors.
"""

from __future__ import annotations

import datetime
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodebook.session import ship_package
from lodebook.sources.ignore import (
    DEFAULT_PATTERNS, IGNORE_FILES, compile_rules, entry_ignored, ignored,
)
from lodebook.sources.languages import detect_language, included

MAX_FILE_SIZE = 1024 * 1024
PARTITION_BYTES = 64 * 1024 * 1024
PARTITION_FILES = 5000
SCAN_SCHEMA = "path string, relative_path string, size long, last_modified timestamp, bytes binary, error string"


class FileChunk(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.max_size = int(options.get("maxfilesize", MAX_FILE_SIZE))
        self.links = options.get("followsymlinks", "false") == "true"
        self.rules = [
            (re.compile(rule.regex, re.S), rule)
            for rule in compile_rules(options.get("ignore", "").split("\n"))
        ]

    def _names(self):
        pending = [""]
        while pending:
            folder = pending.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    name = f"{folder}/{entry.name}".lstrip("/")
                    is_folder = entry.is_dir(follow_symlinks=False)
                    if entry_ignored(name, is_folder, self.rules):
                        continue
                    if is_folder:
                        pending.append(name)
                    elif entry.is_file(follow_symlinks=False) or (
                        self.links and entry.is_symlink() and entry.is_file()
                    ):
                        size = entry.stat().st_size
                        if size <= self.max_size:
                            yield name, size

    def partitions(self):
        chunks, names, total = [], [], 0
        for name, size in self._names():
            if names and (total + size > PARTITION_BYTES or len(names) >= PARTITION_FILES):
                chunks.append(FileChunk(names))
                names, total = [], 0
            names.append(name)
            total += size
        return chunks + [FileChunk(names)]

    def read(self, partition):
        if partition.names and not os.path.isdir(self.root):
            raise FileNotFoundError(f"this worker does not see the root {self.root}")
        for name in partition.names:
            path = os.path.join(self.root, name)
            try:
                info = os.stat(path)
                with open(path, "rb") as handle:
                    content = handle.read()
            except OSError as problem:
                yield path, name, None, None, None, f"{type(problem).__name__}: {problem.strerror}"
                continue
            modified = datetime.datetime.fromtimestamp(info.st_mtime, datetime.timezone.utc)
            yield path, name, info.st_size, modified, content, None


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCAN_SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def ignore_patterns(root: str, patterns: list[str] | None) -> list[str]:
    """Rules of the ignore files at the root first, so that the given ones win."""
    lines: list[str] = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(root, name), encoding="utf-8") as handle:
                lines += handle.read().split("\n")
        except OSError:
            continue
    return lines + (DEFAULT_PATTERNS if patterns is None else patterns)


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None,
              ignore: list[str] | None = None, max_file_size: int | None = None,
              follow_symlinks: bool = False) -> DataFrame:
    """Files below `root`: path, relative_path, content, hash, size, language, last_modified, error.

    A file that cannot be read has an `error` and no content; a root that a worker does not see stops the read.
    """
    ship_package(spark)
    spark.dataSource.register(FileTree)
    raw = (
        spark.read.format("filetree")
        .option("ignore", "\n".join(ignore_patterns(root, ignore)))
        .option("maxfilesize", str(max_file_size or MAX_FILE_SIZE))
        .option("followsymlinks", str(follow_symlinks).lower())
        .load(root)
    )
    return with_derived(raw.filter(included(F.col("relative_path"), include or [])).select(
        # decode() would stop at invalid bytes; a validated cast replaces them instead.
        "path", "relative_path", F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"),
        "size", "last_modified", "error",
    ))


def scan_table(table: DataFrame, include: list[str] | None = None, ignore: list[str] | None = None,
               max_file_size: int | None = None) -> DataFrame:
    """The same scan rules over a table of (path, relative_path, content, size, last_modified).

    This is the way in for a corpus that is already columnar; size and ignore rules run
    before the content is touched.
    """
    path = F.col("relative_path")
    return with_derived(
        table.filter(F.col("size") <= (max_file_size or MAX_FILE_SIZE))
        .filter(~ignored(path, DEFAULT_PATTERNS if ignore is None else ignore))
        .filter(included(path, include or []))
    )


def with_derived(files: DataFrame) -> DataFrame:
    return files.select(
        "path", "relative_path", "content",
        F.sha2("content", 256).alias("hash"),
        F.col("size").cast("long").alias("size"),
        detect_language(F.col("path")).alias("language"),
        "last_modified", *[c for c in ("error",) if c in files.columns],
    )
