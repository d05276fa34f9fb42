"""Git history as tables: commits, changed files and line origins.

Git is called with argument lists and a unit separator between fields, so no path
or subject can be read as something else.
"""

from __future__ import annotations

import datetime
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodebook.session import ship_package

COMMITS_PER_TASK = 1000
UNIT = "\x1f"
RECORD = "\x1e"
HEAD_FORMAT = f"{RECORD}%H{UNIT}%an{UNIT}%ae{UNIT}%aI{UNIT}%s"
LOG_SCHEMA = (
    "ordinal long, hash string, author string, email string, date timestamp, message string, "
    "path string, change_type string, insertions long, deletions long"
)
BLAME_SCHEMA = (
    "line long, hash string, author string, email string, date timestamp, message string, content string"
)
CHANGE_TYPES = {"A": "added", "D": "deleted", "R": "renamed"}


def has_repository(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git"))


def run_git(root: str, *args: str, required: bool = False) -> str:
    """Output of a git command; empty outside a repository or without commits.

    With `required` (in tasks, where the driver has seen the repository) both are errors.
    """
    if not has_repository(root):
        if required:
            raise FileNotFoundError(f"this worker does not see the repository {root}")
        return ""
    done = subprocess.run(["git", *args], cwd=root, capture_output=True, check=False)
    if done.returncode not in (0, 128) or (required and done.returncode):
        raise RuntimeError(done.stderr.decode("utf-8", "replace"))
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


class CommitRange(InputPartition):
    """Up to COMMITS_PER_TASK commits in the order of the log; none stands for no history."""

    def __init__(self, skip: int, ids: list[str] | None):
        self.skip, self.ids = skip, ids


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self):
        # The ids are listed once, in the order of the log, so no task walks what stands before its range.
        ids = run_git(self.root, "log", "--pretty=tformat:%H").split()
        return [CommitRange(skip, ids[skip:skip + COMMITS_PER_TASK]) for skip in range(0, len(ids), COMMITS_PER_TASK)] or [
            CommitRange(0, None)]

    def read(self, partition):
        if not partition.ids:
            return
        log = run_git(
            self.root, "log", "--no-walk=unsorted", "-M", "--root", "--raw", "--numstat", "-z",
            f"--pretty=tformat:{HEAD_FORMAT}", *partition.ids, required=True,
        )
        for offset, record in enumerate(log.split(RECORD)[1:]):
            fields = [f.lstrip("\n") for f in record.split("\0")]
            commit_hash, author, email, date, message = fields[0].split(UNIT)
            head = (partition.skip + offset, commit_hash, author, email,
                    datetime.datetime.fromisoformat(date), message)
            kinds, counts = {}, {}
            rest = iter(fields[1:])
            for field in rest:
                if field.startswith(":"):
                    kind = field.split(" ")[-1][:1]
                    path = next(rest)
                    kinds[next(rest) if kind in "RC" else path] = kind
                elif "\t" in field:
                    added, removed, path = field.split("\t", 2)
                    if not path:
                        next(rest)
                        path = next(rest)
                    counts[path] = (int(added) if added.isdigit() else 0,
                                    int(removed) if removed.isdigit() else 0)
            for path, kind in kinds.items():
                yield (*head, path, CHANGE_TYPES.get(kind, "modified"), *counts.get(path, (0, 0)))
            if not kinds:
                yield (*head, None, None, 0, 0)


class GitLog(DataSource):
    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema):
        return GitLogReader(self.options)


class GitBlameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        if self.options.get("required") == "true" and not has_repository(self.options["path"]):
            raise FileNotFoundError(f"this worker does not see the repository {self.options['path']}")
        first = int(self.options["linestart"])
        out = run_git(
            self.options["path"], "blame", "-L", f"{first},{self.options['lineend']}",
            "--line-porcelain", "--", self.options["file"],
        )
        entry: dict[str, str] = {}
        number = first
        for line in out.split("\n"):
            key, _, value = line.partition(" ")
            if line.startswith("\t"):
                date = datetime.datetime.fromtimestamp(int(entry["author-time"]), datetime.timezone.utc)
                yield (number, entry["hash"], entry["author"], entry["author-mail"].strip("<>"), date,
                       entry.get("summary", ""), line[1:])
                number += 1
                entry = {}
            elif not entry:
                entry = {"hash": key}
            else:
                entry[key] = value


class GitBlame(DataSource):
    @classmethod
    def name(cls):
        return "gitblame"

    def schema(self):
        return BLAME_SCHEMA

    def reader(self, schema):
        return GitBlameReader(self.options)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """One row per commit and changed file; `ordinal` is git's own order, newest first."""
    ship_package(spark)
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").load(root)


def commits_of(log: DataFrame) -> DataFrame:
    return log.select("ordinal", "hash", "author", "email", "date", "message").dropDuplicates(["hash"])


def changes_of(log: DataFrame) -> DataFrame:
    return log.filter("path IS NOT NULL").select(
        "ordinal", "hash", "author", "email", "date", "message",
        "path", "change_type", "insertions", "deletions",
    )


def read_blame(spark: SparkSession, root: str, file: str, line_start: int, line_end: int) -> DataFrame:
    """Who last changed each line of a range of one file (empty when git cannot tell)."""
    ship_package(spark)
    spark.dataSource.register(GitBlame)
    return (
        spark.read.format("gitblame").option("file", file).option("required", str(has_repository(root)).lower())
        .option("linestart", str(line_start)).option("lineend", str(line_end)).load(root)
    )


def last_commit_for_line(spark: SparkSession, root: str, file: str, line: int) -> DataFrame:
    return read_blame(spark, root, file, line, line).drop("line", "content")
