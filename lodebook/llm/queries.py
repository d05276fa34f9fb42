"""The registered queries of these operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodebook.llm import chat, decontaminate, html_text, licenses, mixing, ngram_join, phrases, pii, secret_scan, toxicity, whitening
from lodebook.llm.fingerprints import neighbour_likeness
from lodebook.llm.token_counts import token_counts
from lodebook.sources.tables import read_table


def op1_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, folder, "documents"))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digests(read_table(spark, folder, "documents"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(read_table(spark, folder, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.with_awkward_turns(read_table(spark, folder, "conversations"))
    return chat.conversation_digests(chat.format_conversations(rows))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return toxicity.score_texts(docs, toxicity.fit_classifier(docs, read_table(spark, folder, "labels")))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_likeness(read_table(spark, folder, "documents"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digests(read_table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read_table(spark, folder, "documents"))


def op12_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_labels(read_table(spark, folder, "documents"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


QUERIES = {q.__name__: q for q in (
    op1_mixing_sources, op2_ngram_jaccard_join, op3_secret_scans, op4_html_extraction, op5_benchmark_decontamination, op6_chat_formatting, op7_toxicity, op8_token_counts, op9_document_fingerprints, op10_personal_data,
    op11_phrase_collocations, op12_license_scans, op13_embedding_whitening)}
ORACLES = {"op1_mixing_sources": mixing.SQL, "op10_personal_data": pii.SQL, "op11_phrase_collocations": phrases.SQL, "op12_license_scans": licenses.SQL}
