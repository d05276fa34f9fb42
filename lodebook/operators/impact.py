"""What a change to a symbol would touch, and how risky it looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.functions import paths
from lodebook.operators.graph import refers_to
from lodebook.operators.usages import mention_lines

TOP_FILES = 20


def edge_references(edges: DataFrame, name: str, symbol_id) -> DataFrame:
    """Per calling file: the lines of its calls, repeated lines kept."""
    return (
        edges.filter(refers_to(name, symbol_id))
        .groupBy(F.col("caller_file_id").alias("file_id"))
        .agg(F.sort_array(F.collect_list("line_number")).alias("edge_lines"))
    )


def affected_files(files: DataFrame, edges: DataFrame, name: str, symbol_id, own_file_id,
                   texts: DataFrame | None = None) -> DataFrame:
    """file_id, path, reference_count, lines, is_test, category: one row per affected file.

    Calls count as often as they occur. Where the text of another file mentions the name
    as well, its distinct lines count instead. `texts` may have fewer files, as long as all that hold the name are there.
    """
    texts = files if texts is None else texts
    by_edge = edge_references(edges, name, symbol_id).join(files.select("file_id", "relative_path"), "file_id")
    by_text = mention_lines(texts.filter(F.col("file_id") != own_file_id), name)
    merged = by_edge.withColumnRenamed("relative_path", "edge_path").join(by_text, "file_id", "full")
    lines = (
        F.when(F.col("edge_lines").isNull(), F.col("lines"))
        .when(F.col("lines").isNull(), F.col("edge_lines"))
        .otherwise(F.array_sort(F.array_union("edge_lines", "lines")))
    )
    return describe_files(merged.select(
        "file_id", F.coalesce("relative_path", "edge_path").alias("path"), lines.alias("lines")))


def describe_files(found: DataFrame) -> DataFrame:
    path = F.col("path")
    return found.select(
        "file_id", "path", F.size("lines").cast("long").alias("reference_count"), "lines",
        paths.is_test(path).alias("is_test"), paths.category(path).alias("category"))


def top_affected(affected: DataFrame, limit: int | None = TOP_FILES) -> DataFrame:
    ordered = affected.orderBy(F.col("reference_count").desc(), "path", "file_id")
    return ordered if limit is None else ordered.limit(limit)


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def totals(affected: DataFrame) -> DataFrame:
    """One row: references, files, tests, and files per category."""
    return affected.agg(
        F.coalesce(F.sum("reference_count"), F.lit(0)).alias("direct_references"),
        F.count(F.lit(1)).alias("files_affected"),
        _count(F.col("is_test")).alias("tests_affected"),
        *[_count(F.col("category") == c).alias(c) for c in ("implementation", "tests", "configs", "other")],
    )


def symbols_affected(edges: DataFrame, symbols: DataFrame, name: str, symbol_id) -> DataFrame:
    """Distinct names of the symbols that call this one (anonymous callers left out)."""
    callers = edges.filter(refers_to(name, symbol_id)).select("caller_symbol_id").distinct()
    named = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name"))
    return callers.join(named, "caller_symbol_id").filter(F.col("name") != "").select("name").distinct()


def with_risk(total: DataFrame, name: Column, kind: Column) -> DataFrame:
    """Adds risk_score, risk_level, risk_factors and suggestions to a row of totals."""
    refs, files = F.col("direct_references"), F.col("files_affected")
    no_tests = (F.col("tests_affected") == 0) & (refs > 0)
    is_type = kind.isin("interface", "type")
    is_public = F.lower(name).contains("api") | F.lower(name).contains("public")
    # Thresholds, points and texts of the risk rules.
    rules = [
        (refs > 50, 3, F.format_string("High reference count (%d)", refs)),
        ((refs > 20) & (refs <= 50), 2, F.format_string("Moderate reference count (%d)", refs)),
        ((refs > 5) & (refs <= 20), 1, F.format_string("Some references (%d)", refs)),
        (files > 10, 2, F.format_string("Many files affected (%d)", files)),
        ((files > 5) & (files <= 10), 1, F.format_string("Several files affected (%d)", files)),
        (no_tests, 2, F.lit("No test coverage detected")),
        (is_type, 1, F.lit("Type/Interface changes affect compile-time")),
        (is_public, 2, F.lit("Appears to be a public API")),
    ]
    score = F.lit(0)
    for condition, points, _ in rules:
        score = score + F.when(condition, points).otherwise(0)
    level = (
        F.when(F.col("risk_score") >= 7, "CRITICAL").when(F.col("risk_score") >= 5, "HIGH")
        .when(F.col("risk_score") >= 3, "MEDIUM").otherwise("LOW")
    )
    severe = F.col("risk_level").isin("CRITICAL", "HIGH")
    # Texts of the suggestions.
    suggestions = [
        (severe, "Consider creating a compatibility layer before making breaking changes"),
        (severe, "Document the migration path for consumers"),
        (no_tests, "Add tests before modifying this symbol"),
        (refs > 20, "Consider refactoring in stages to minimize risk"),
        (refs > 20, "Use deprecation warnings before removal"),
        (is_type, "Type changes will require recompilation of dependent code"),
    ]
    return (
        total.withColumn("risk_score", score)
        .withColumn("risk_level", level)
        .withColumn("risk_factors", F.array_compact(F.array(*[F.when(c, t) for c, _, t in rules])))
        .withColumn("suggestions", F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in suggestions])))
    )


def unindexed(files: DataFrame, name: str) -> DataFrame:
    """Affected files of a name that is no symbol: all files whose lines hold it."""
    found = mention_lines(files, name)
    return describe_files(found.select("file_id", F.col("relative_path").alias("path"), "lines"))


def unindexed_totals(affected: DataFrame) -> DataFrame:
    refs = F.col("direct_references")
    return affected.agg(
        F.coalesce(F.sum("reference_count"), F.lit(0)).alias("direct_references"),
        F.count(F.lit(1)).alias("files_affected"),
        _count(F.col("is_test")).alias("tests_affected"),
        _count(~F.col("is_test")).alias("implementation"),
    ).select(
        "*",
        F.col("tests_affected").alias("tests"), F.lit(0).cast("long").alias("configs"), F.lit(0).cast("long").alias("other"),
        F.when(refs > 10, "HIGH").when(refs > 5, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.array(F.format_string("Symbol not indexed but found %d text references", refs)).alias("risk_factors"),
        F.array(F.lit("Consider indexing this symbol for better analysis")).alias("suggestions"),
    ).filter(F.col("files_affected") > 0)
