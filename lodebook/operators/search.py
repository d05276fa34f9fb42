"""Ranked full-text search over a table of texts.

`ranked_scan` answers from the texts alone, in one pass over them. For a corpus
that is searched often, `postings` keeps an inverted index instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.functions import bm25, text
from lodebook.functions.match import Match, match_of

FILE_COLUMNS = ("relative_path", "content", "language")
SYMBOL_COLUMNS = ("name", "signature", "documentation")
REST_GROUPS = 64


def _hit_counts(table: DataFrame, match: Match, columns: tuple, carry: list[str]) -> DataFrame:
    """`carry` columns, the document length and the hits of every phrase (`f0`, `f1`, ...)."""
    tokenized = table.select(
        *carry, *[text.tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"tokens_{c}") for c in columns]
    )
    arrays = [F.col(f"tokens_{c}") for c in columns]

    def total(parts: list[Column]) -> Column:
        result = parts[0]
        for part in parts[1:]:
            result = result + part
        return result

    return tokenized.select(
        *carry,
        total([F.size(a) for a in arrays]).cast("long").alias("doc_length"),
        *[
            total([text.phrase_count(a, list(p)) for a in arrays]).cast("long").alias(f"f{i}")
            for i, p in enumerate(match.phrases)
        ],
    )


def ranked_scan(table: DataFrame, term: str, key: str = "file_id", columns: tuple = FILE_COLUMNS,
                carry: tuple = (), languages: list[str] | None = None) -> DataFrame:
    """All matching rows with `score` (lower is better): `key`, `carry`, `score`.

    One pass over the texts yields a narrow row per document. Documents that do not
    match only matter for the corpus statistics, so a partial aggregation folds them
    to a few rows per task before the shuffle; matching documents keep their own row.
    The statistics are a scalar subquery over the same shuffle output.
    """
    match = match_of(term)
    if match is None:
        raise ValueError(f"nothing to search for in {term!r}; use like_files")
    kept = [key, *carry, *(["language"] if languages and "language" not in carry else [])]
    return score_counts(_hit_counts(table, match, columns, kept), match, key, list(carry), languages)


def score_counts(counted: DataFrame, match: Match, key: str, carry: list[str],
                 languages: list[str] | None = None) -> DataFrame:
    """Scores from one row per document with `doc_length` and hits `f0`, `f1`, ..."""
    names = [f"f{i}" for i in range(len(match.phrases))]
    hit = match.condition([F.col(n) for n in names])
    if languages:
        hit = hit & F.coalesce(F.col("language").isin(languages), F.lit(False))
    marked = counted.withColumn("hit", hit)
    grouped = (
        marked.select(
            F.when(F.col("hit"), F.lit(-1))
            .otherwise(F.pmod(F.xxhash64(key), F.lit(REST_GROUPS))).alias("rest_group"),
            *[F.when(F.col("hit"), F.col(c)).alias(c) for c in [key, *carry]],
            "hit",
            "doc_length",
            *names,
        )
        .groupBy("rest_group", key, *carry)
        .agg(
            # One packed column, the mark of a hit included: both readers below need all of it
            # and no filter moves below the shuffle, so they share it.
            F.struct(
                F.max("hit").alias("hit"),
                F.count(F.lit(1)).alias("docs"),
                F.sum("doc_length").alias("doc_length"),
                *[F.sum(n).alias(n) for n in names],
                *[F.sum((F.col(n) > 0).cast("long")).alias(f"n_{n}") for n in names],
            ).alias("packed")
        )
        .select("rest_group", key, *carry, "packed")
    )
    corpus = grouped.agg(
        F.struct(
            F.sum("packed.docs").alias("total"),
            F.sum("packed.doc_length").alias("total_length"),
            *[F.sum(f"packed.n_{n}").alias(f"n_{n}") for n in names],
        ).alias("corpus")
    ).scalar()
    scored_names = [names[i] for i in match.scored]
    return (
        grouped.filter("packed.hit")
        .withColumn("corpus", corpus)
        .select(
            key,
            *carry,
            bm25.score(
                [F.col(f"packed.{n}") for n in scored_names],
                [F.col(f"corpus.n_{n}") for n in scored_names],
                F.col("packed.doc_length"),
                F.col("corpus.total"),
                F.col("corpus.total_length"),
            ).alias("score"),
        )
    )


SORT_KEYS = {
    "relevance": lambda: [F.col("score")],
    "path": lambda: [F.col("relative_path")],
    "size": lambda: [F.col("size").desc()],
    "modified": lambda: [F.col("last_modified").desc()],
}


def search_files(files: DataFrame, term: str, sort_by: str = "relevance", limit: int = 10,
                 languages: list[str] | None = None, key: str = "file_id") -> DataFrame:
    """Top files for a term; LIKE by path when the term has no searchable word."""
    wanted = ["relative_path", "language", "size"]
    if sort_by == "modified":
        wanted.append("last_modified")
    if match_of(term) is None:
        return like_files(files, term, languages=languages, key=key)
    hits = ranked_scan(files, term, key=key, carry=tuple(wanted), languages=languages)
    return hits.orderBy(*SORT_KEYS[sort_by](), key).limit(limit)


def like_files(files: DataFrame, term: str, limit: int = 100, languages: list[str] | None = None,
               key: str = "file_id") -> DataFrame:
    hits = files.filter(text.like_ci(F.col("content"), term))
    if languages:
        hits = hits.filter(F.col("language").isin(languages))
    return (
        hits.select(key, "relative_path", "language", "size", F.lit(None).cast("double").alias("score"))
        .orderBy("relative_path", key)
        .limit(limit)
    )


def has_word(content: Column, word: str) -> Column:
    """Whether the text holds a token; the substring test spares most texts the tokens."""
    return text.fold(content).contains(word) & F.array_contains(text.tokens(content), word)


def snippet(content: Column, phrase: list[str], width: int = 32) -> Column:
    """The words around the first hit, the hit marked, cut ends shown by dots."""
    words = F.regexp_extract_all(content, F.lit(text.TOKEN_PATTERN), F.lit(0))
    folded = F.transform(words, text.fold)
    at = F.array_position(folded, phrase[0]).cast("int")
    first = F.greatest(F.lit(1), at - width // 2)
    window = F.slice(words, first, F.lit(width))
    marked = F.transform(
        window,
        lambda w, i: F.when(i + first == at, F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w),
    )
    return F.when(
        at > 0,
        F.concat(
            F.when(first > 1, "...").otherwise(""),
            F.array_join(marked, " "),
            F.when(first + width <= F.size(words), "...").otherwise(""),
        ),
    )
