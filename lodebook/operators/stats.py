"""Statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(files: DataFrame) -> DataFrame:
    """file_count, total_size, total_tokens, last_indexed."""
    return files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.max("indexed_at").alias("last_indexed"),
    )


def counts_by(table: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per known value, most frequent first."""
    counted = (
        table.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), column)
    )
    return counted if limit is None else counted.limit(limit)


def language_share(files: DataFrame) -> DataFrame:
    """Languages with their share of all files in percent and a bar scaled to 20."""
    per_language = files.groupBy("language").agg(F.count(F.lit(1)).alias("count"))
    sums = per_language.agg(F.struct(
        F.sum("count").alias("total"), F.max(F.when(F.col("language").isNotNull(), F.col("count"))).alias("top"),
    ).alias("sums")).scalar()
    return (
        per_language.filter("language IS NOT NULL").withColumn("sums", sums)
        .select(
            "language", "count",
            F.round(F.col("count") * 100.0 / F.col("sums.total"), 1).alias("percentage"),
            F.floor(F.col("count") * 20.0 / F.col("sums.top") + 0.5).cast("long").alias("bar"),
        )
        .orderBy(F.col("count").desc(), "language")
    )


def largest_files(files: DataFrame, limit: int = 10) -> DataFrame:
    return files.select("relative_path", "size", "tokens").orderBy(F.col("size").desc(), "relative_path").limit(limit)
