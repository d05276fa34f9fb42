"""Version history: who changed what, how often, and what changes together.

`changes` holds one row per commit and file: hash, author, date, path and more;
`ordinal` numbers commits from the newest. The clock is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMIT = ["hash", "author", "email", "date", "message"]


def commits_for(changes: DataFrame, path: str) -> DataFrame:
    return changes.filter(F.col("path") == path)


def recent_commits(changes: DataFrame, path: str, limit: int = 20) -> DataFrame:
    return commits_for(changes, path).orderBy("ordinal").limit(limit)


def file_changes(changes: DataFrame, path: str, limit: int = 10) -> DataFrame:
    return recent_commits(changes, path, limit).select(*COMMIT, "path", "change_type", "insertions", "deletions")


def within(date: Column, now: Column, days: int) -> Column:
    return date > now - F.make_interval(days=F.lit(days))


def change_frequency(commits: DataFrame, now: Column) -> DataFrame:
    """One row: commits of the last 7, 30 and 90 days (the boundary itself is out)."""
    def recent(days: int) -> Column:
        return F.coalesce(F.sum(within(F.col("date"), now, days).cast("long")), F.lit(0))

    return commits.agg(*[recent(d).alias(f"last_{d}_days") for d in (7, 30, 90)])


def summary(commits: DataFrame) -> DataFrame:
    """total_commits, unique_authors, last_modified and first_seen in one pass."""
    return commits.agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.countDistinct("author").alias("unique_authors"),
        F.min_by("date", "ordinal").alias("last_modified"),
        F.max_by("date", "ordinal").alias("first_seen"),
    )


def authors(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.col("commits").desc(), "author")


def co_changed(changes: DataFrame, path: str, base: int = 50, limit: int = 10) -> DataFrame:
    """Files most often changed together with one file, over its newest `base` commits.

    The left side is at most `base` hashes, so the history is scanned once against a
    handful of keys and no pairs within a commit are made.
    """
    own = recent_commits(changes, path, base).select("hash").distinct()
    return (
        changes.filter(F.col("path") != path).select("hash", "path").distinct()
        .join(own, "hash", "left_semi")
        .groupBy("path").agg(F.count(F.lit(1)).alias("co_change_count"))
        .orderBy(F.col("co_change_count").desc(), "path")
        .limit(limit)
    )


def recent_changes(changes: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The commits of each file of the last days as rows: most changed file first, its newest commit first.

    `commits` is the number of the file's commits. Counts are combined before they are shuffled and joined back, so
    a file that is in every commit is no group of its own in any task.
    """
    recent = changes.filter(within(F.col("date"), now, days)).select(
        "path", "ordinal", *[c for c in COMMIT if c in changes.columns])
    counts = recent.groupBy("path").agg(F.count(F.lit(1)).alias("commits"))
    return recent.join(counts, "path").orderBy(F.col("commits").desc(), "path", "ordinal")
