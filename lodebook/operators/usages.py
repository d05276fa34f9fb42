"""Where a symbol is used, found in the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.functions import paths, text
from lodebook.operators.packing import pack

# Shapes of a line that uses a symbol; {} is its name.
USAGE_SHAPES = [
    "new {}", "{}(", "{}.", "<{}", ": {}", "extends {}", "implements {}", "from '.*{}", "import.*{}",
]


def is_usage(line: Column, name: str) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(shape.format(name)) for shape in USAGE_SHAPES])


def usage_lines(files: DataFrame, name: str) -> DataFrame:
    """file_id, relative_path, lines: the numbers of the lines that use the symbol.

    No shape spans lines, so a text has such a line exactly if the whole text passes the
    test: texts without one are never split, and nothing is shuffled.
    """
    return files.filter(F.col("content").contains(name) & is_usage(F.col("content"), name)).select(
        "file_id", "relative_path",
        text.line_numbers(F.col("content"), lambda line: is_usage(line, name)).alias("lines"))


def mention_lines(files: DataFrame, name: str) -> DataFrame:
    """file_id, relative_path, lines that hold the name anywhere."""
    return files.filter(F.col("content").contains(name)).select(
        "file_id", "relative_path",
        text.line_numbers(F.col("content"), lambda line: line.contains(name)).alias("lines"))


def candidate_files(files: DataFrame, symbols: DataFrame, name: str, languages: list[str] | None = None,
                    limit: int | None = 20) -> DataFrame:
    """Files that mention the name and do not define it; other files before tests, then by path."""
    defining = symbols.filter(F.col("name") == name).select("file_id").distinct()
    hits = files.filter(text.like_ci(F.col("content"), name))
    if languages:
        hits = hits.filter(F.col("language").isin(languages))
    path = F.col("relative_path")
    hits = hits.select("file_id", "relative_path", "language").join(defining, "file_id", "left_anti")
    ordered = hits.withColumn("is_test", paths.loosely_test(path).cast("int")).orderBy("is_test", "relative_path", "file_id")
    return ordered if limit is None else ordered.limit(limit)


def find_usages(files: DataFrame, symbols: DataFrame, name: str, max_tokens: int = 4000,
                languages: list[str] | None = None, limit: int = 20, include_content: bool = False) -> DataFrame:
    """Candidate files (at most `limit`) with their usage lines, packed under a token budget.

    Rows have the file's path, language, tokens and imports (where known), preview or content and lines; what the budget
    is charged is the row as JSON. Texts are read again for the few chosen ids only.
    """
    chosen = {r.file_id: r.is_test for r in candidate_files(files, symbols, name, languages, limit).collect()}
    wanted = files.filter(F.col("file_id").isin(list(chosen)))
    body = F.col("content") if include_content else text.preview(F.col("content"))
    known = [c for c in ("path", "tokens", "imports") if c in files.columns]
    rows = wanted.select("file_id", "relative_path", "language", *known, body.alias("content" if include_content else "preview"))
    found = rows.join(usage_lines(wanted, name).drop("relative_path"), "file_id")
    tests = [i for i, is_test in chosen.items() if is_test]
    shown = found.withColumn("result_tokens", text.estimate_tokens(F.to_json(F.struct(*found.columns)))).withColumn(
        "is_test", F.col("file_id").isin(tests).cast("int"))
    order = [F.col("is_test"), F.col("relative_path"), F.col("file_id")]
    return pack(shown, max_tokens, order, tokens="result_tokens").orderBy(*order)
