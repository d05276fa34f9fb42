"""The inverted index: one row per (term, document, field) with the positions of the term.

Each task writes the rows of the documents that it reads in long runs sorted by term, so that
nothing is shuffled and a query skips, by the bounds of the pages, all but the stretches with its
own words. A common word is spread over the files of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.functions import bm25, text
from lodebook.functions.match import Match, match_of
from lodebook.operators.search import FILE_COLUMNS
from lodebook.session import ship_package

RUN_TOKENS = 2_000_000  # a run of documents that are sorted together
ROWS_OUT = 50_000


def _field_tokens(columns: tuple) -> list[Column]:
    return [text.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns]


def document_length(columns: tuple = FILE_COLUMNS) -> Column:
    """Tokens of a document over all its indexed fields."""
    return reduce(lambda a, b: a + b, [F.size(t) for t in _field_tokens(columns)]).cast("long")


def build(table: DataFrame, key: str = "file_id", columns: tuple = FILE_COLUMNS, carry: tuple = ()) -> DataFrame:
    """term, key, carry, field, positions, doc_length, in runs sorted by term. Narrow: words are grouped where they are read."""
    ship_package(table.sparkSession)
    source = table.select(key, *carry, F.array(*_field_tokens(columns)).alias("fields"))
    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (key, *carry))
    names = ["term", key, *carry, "field", "positions", "doc_length"]
    width = len(columns)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.diff(batch.column(batch.num_columns - 1).flatten().offsets.to_numpy()).reshape(-1, width).sum(1)
            run = np.cumsum(tokens) // RUN_TOKENS
            bounds = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
            for start, stop in zip(bounds, bounds[1:]):
                part = batch.slice(start, stop - start)
                lists = part.column(part.num_columns - 1).flatten()
                sizes = np.diff(lists.offsets.to_numpy())
                words = lists.flatten().dictionary_encode()
                if not len(words):
                    continue
                ranks = pc.sort_indices(words.dictionary).to_numpy()  # in the order of bytes
                rank_of = np.empty(len(ranks), np.int64)
                rank_of[ranks] = np.arange(len(ranks))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                position = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                code = rank_of[words.indices.to_numpy()] * np.int64(len(sizes)) + owner
                order = np.argsort(code, kind="stable")
                code = code[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                term, place = ranks[code[first] // len(sizes)], code[first] % len(sizes)
                row, field = place // width, (place % width).astype(np.int32)
                lengths = sizes.reshape(-1, width).sum(1)[row].astype(np.int64)
                ends = np.append(first, len(code))
                position = position[order].astype(np.int32)
                for at in range(0, len(first), ROWS_OUT):
                    some, edge = slice(at, at + ROWS_OUT), ends[at:at + ROWS_OUT + 1]
                    positions = pa.ListArray.from_arrays(
                        pa.array((edge - edge[0]).astype(np.int32)), pa.array(position[edge[0]:edge[-1]]))
                    yield pa.RecordBatch.from_arrays(
                        [words.dictionary.take(pa.array(term[some])), *(part.column(i).take(pa.array(row[some])) for i in range(1 + len(carry))),
                         pa.array(field[some]), positions, pa.array(lengths[some])], names)

    return source.mapInArrow(group, f"term string, {kept}, field int, positions array<int>, doc_length long")


def write(postings: DataFrame, path: str, ordered: bool = True) -> None:
    """Each task writes its own rows; unless they are `ordered` in runs, as `build` gives them, it sorts them by term."""
    (postings if ordered else postings.sortWithinPartitions("term")).write.parquet(path)


def _occurrences(at: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of the phrase from the position lists of its words in one field."""
    empty = F.array().cast("array<int>")

    def starts(offset: int, word: str) -> Column:
        return F.transform(F.coalesce(F.element_at(at, word), empty), lambda p: p - offset)

    found = reduce(F.array_intersect, [starts(i, w) for i, w in enumerate(phrase)])
    return F.size(found).cast("long")


def hits(postings: DataFrame, match: Match, key: str = "file_id", carry: tuple = ()) -> DataFrame:
    """key, carry, doc_length and the hits `f0`, `f1`, ... of each phrase, for documents with any word."""
    wanted = postings.filter(F.col("term").isin(match.words()))
    names = [f"f{i}" for i in range(len(match.phrases))]
    per_field = wanted.groupBy(key, *carry, "doc_length", "field").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    counted = per_field.select(
        key, *carry, "doc_length", *[_occurrences(F.col("at"), p).alias(n) for n, p in zip(names, match.phrases)])
    return counted.groupBy(key, *carry, "doc_length").agg(*[F.sum(n).alias(n) for n in names])


def ranked(postings: DataFrame, term: str, total, total_length, key: str = "file_id", carry: tuple = (),
           bucketed: bool = False) -> DataFrame:
    """key, carry and score of every document that matches the term.

    `total` documents with `total_length` tokens are the corpus: numbers, or columns such as
    scalar subqueries when the postings are not a stored table. `bucketed` has no effect any more.
    """
    match = match_of(term)
    if match is None:
        raise ValueError(f"nothing to search for in {term!r}")
    counted = hits(postings, match, key, carry)
    names = [f"f{i}" for i in range(len(match.phrases))]
    seen = counted.agg(F.struct(*[F.sum((F.col(n) > 0).cast("long")).alias(n) for n in names]).alias("seen")).scalar()
    scored = [names[i] for i in match.scored]

    def number(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return (
        counted.filter(match.condition([F.col(n) for n in names]))
        .withColumn("seen", seen)
        .select(key, *carry, bm25.score(
            [F.col(n) for n in scored], [F.col(f"seen.{n}") for n in scored],
            F.col("doc_length"), number(total), number(total_length)).alias("score"))
    )
