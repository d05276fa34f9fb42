"""From raw documents to a training mix: STAGES in order, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; the other tables come from sf_dir. All but the last
give the columns of documents. Extra columns pass through the stages. Null and empty texts are clean documents: they
pass, empty ones as copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodebook.llm import decontaminate, mixing, ngram_join, secret_scan, toxicity
from lodebook.session import new_scratch_path
from lodebook.sources.tables import read_table


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this stage's input, does not reject."""
    model = toxicity.fit_classifier(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; rows that repeat its id go as well."""
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    others = groups.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    repeated = groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    if repeated.isEmpty():
        return kept
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.where(F.col("doc_id").isNull()))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item, edited ones included."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars following the text."""
    clean = secret_scan.redact(docs, secret_scan.learn_formats(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                            .otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with `taken`, the words that it takes of each (repeats counted); others are left out.

    The result has doc_id, source, size, source_size, target, epochs and taken.
    """
    mixed = mixing.mix_documents(docs, read_table(spark, sf_dir, "labels"))
    return mixed.where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Classifier, join, alignment and learned formats have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, beginning with documents; each result is written to the shared folder and read as the next input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
