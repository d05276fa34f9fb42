"""Parquet tables as files, symbols, calls and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"),
        F.col("text").alias("content"), F.col("lang").alias("language"), F.col("n_chars").alias("size"))


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select(
        F.col("page_id").alias("file_id"), F.col("url").alias("relative_path"), F.col("html").alias("content"),
        F.lit("html").alias("language"), F.length("html").cast("long").alias("size"))


def part_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as symbols: the name is searched, the type and brand are shown."""
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
        F.col("p_brand").alias("signature"), F.lit(None).cast("string").alias("documentation"))


def order_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits (customer = author) that change the parts on their lines."""
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"))
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"))
    return lines.join(orders, "hash")


def order_commits(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"))
