"""Symbol lookup: ranked by relevance, exact name and length of name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.functions import text
from lodebook.functions.match import clean_term, match_of
from lodebook.operators.search import SYMBOL_COLUMNS, ranked_scan

RESULT = ["symbol_id", "name", "type", "file_path", "line_start", "line_end", "signature"]


def with_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path and language of their file; the text is never read."""
    return symbols.join(files.select("file_id", F.col("relative_path").alias("file_path"), "language"), "file_id")


def top_symbols(symbols: DataFrame, files: DataFrame, hits: DataFrame, order: list, limit: int,
                languages: list[str] | None = None) -> DataFrame:
    """The first `limit` hits (symbol_id, name, score) in an order, with RESULT and their `position`.

    Without a language filter details are read for the ids of these few rows only, as literals.
    """
    if languages:
        located = with_file(symbols.drop("name").join(hits, "symbol_id"), files)
        hits = located.filter(F.col("language").isin(languages)).select(*hits.columns)
    kind = symbols.schema["symbol_id"].dataType
    top = [r.symbol_id for r in hits.orderBy(*order).limit(limit).collect()]
    position = F.array_position(F.array(*[F.lit(i).cast(kind) for i in top]), F.col("symbol_id")) if top else F.lit(0)
    chosen = symbols.filter(F.col("symbol_id").isin(top))
    return with_file(chosen, files).select(*RESULT, position.cast("int").alias("position")).orderBy("position")


def scan_hits(symbols: DataFrame, term: str) -> DataFrame:
    """symbol_id, name and score of the symbols that match, from their names and signatures."""
    return ranked_scan(symbols, term, key="symbol_id", columns=SYMBOL_COLUMNS, carry=("name",))


def find_symbol(symbols: DataFrame, files: DataFrame, name: str, languages: list[str] | None = None,
                limit: int = 20, hits: DataFrame | None = None) -> DataFrame:
    """The best symbols for a name: by relevance, then exact name, then short names.

    `hits` may come from an inverted index; otherwise the symbols are scanned.
    """
    match = match_of(name)
    exact = F.when(F.col("name") == (clean_term(name) if match else name), 0).otherwise(1)
    order = [exact, F.length("name"), F.col("symbol_id")]
    if match:
        found = scan_hits(symbols, name) if hits is None else hits
        return top_symbols(symbols, files, found, [F.col("score"), *order], limit, languages)
    found = symbols.filter(text.like_ci(F.col("name"), name)).select("symbol_id", "name")
    return top_symbols(symbols, files, found, order, limit, languages)


def search_symbols(symbols: DataFrame, files: DataFrame, term: str, languages: list[str] | None = None,
                   limit: int = 15, like_limit: int = 100, hits: DataFrame | None = None) -> DataFrame:
    """Symbols for the broad search: the first `limit` by relevance, or `like_limit` by name where only LIKE applies."""
    if match_of(term):
        found = scan_hits(symbols, term) if hits is None else hits
        return top_symbols(symbols, files, found, [F.col("score"), F.col("symbol_id")], limit, languages)
    found = like_symbols(symbols, term).select("symbol_id", "name")
    return top_symbols(symbols, files, found, [F.col("name"), F.col("symbol_id")], like_limit, languages)


def like_symbols(symbols: DataFrame, term: str) -> DataFrame:
    return symbols.filter(
        text.like_ci(F.col("name"), term) | text.like_ci(F.coalesce("signature", F.lit("")), term))


def first_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol a name stands for: the first of that exact name (at most one row)."""
    return symbols.filter(F.col("name") == name).orderBy("symbol_id").limit(1)


def symbols_per_file(symbols: DataFrame) -> DataFrame:
    """file_id with its symbols ordered by line."""
    entry = F.struct("line_start", "symbol_id", "name", "type", "line_end", "signature")
    return symbols.groupBy("file_id").agg(F.sort_array(F.collect_list(entry)).alias("symbols"))
