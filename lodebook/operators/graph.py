"""The call graph: what a symbol calls, what calls it, and the neighbourhood of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.session import cut_lineage, materialize


def outgoing(edges: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id) -> DataFrame:
    """Calls made by one symbol, ordered by line, with what is known about the callee."""
    callee = symbols.select(
        F.col("symbol_id").alias("callee_symbol_id"), F.col("type").alias("callee_type"),
        F.col("line_start").alias("callee_line"), F.col("file_id").alias("symbol_file_id"))
    paths = files.select(F.col("file_id").alias("target_file_id"), F.col("relative_path").alias("callee_path"))
    made = edges.filter(F.col("caller_symbol_id") == symbol_id)
    return (
        made.join(callee, "callee_symbol_id", "left")
        .withColumn("target_file_id", F.coalesce("callee_file_id", "symbol_file_id"))
        .join(paths, "target_file_id", "left")
        .select(
            F.col("callee_name").alias("name"), F.coalesce(_filled("callee_type"), F.col("call_type")).alias("type"),
            F.coalesce(_filled("callee_path"), F.lit("external")).alias("file_path"),
            F.coalesce("callee_line", F.lit(0)).alias("line"), "call_type", F.col("line_number").alias("call_line"),
            "callee_symbol_id",
        )
        .orderBy("call_line", "name")
    )


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def refers_to(name: str, symbol_id) -> Column:
    """Edges that point to a symbol by name or by resolved id; a NULL id points nowhere."""
    by_name = F.col("callee_name") == name
    return by_name if symbol_id is None else by_name | F.coalesce(F.col("callee_symbol_id") == symbol_id, F.lit(False))


def incoming(edges: DataFrame, symbols: DataFrame, files: DataFrame, name: str, symbol_id) -> DataFrame:
    """Calls of one symbol, ordered by path and line, with what is known about the caller."""
    caller = symbols.select(
        F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller_name"),
        F.col("type").alias("caller_type"), F.col("line_start").alias("caller_line"))
    paths = files.select(F.col("file_id").alias("caller_file_id"), F.col("relative_path").alias("caller_path"))
    return (
        edges.filter(refers_to(name, symbol_id))
        .join(caller, "caller_symbol_id", "left")
        .join(paths, "caller_file_id", "left")
        .select(
            F.coalesce(_filled("caller_name"), F.lit("anonymous")).alias("name"),
            F.coalesce(_filled("caller_type"), F.lit("unknown")).alias("type"),
            F.coalesce(_filled("caller_path"), F.lit("unknown")).alias("file_path"),
            F.coalesce(F.nullif("caller_line", F.lit(0)), F.col("line_number")).alias("line"),
            "call_type", F.col("line_number").alias("call_line"), "caller_symbol_id",
        )
        .orderBy("file_path", "call_line", "name")
    )


def named_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (caller, callee) names; calls outside any symbol have no caller name."""
    callers = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller"))
    slim = edges.filter("caller_symbol_id IS NOT NULL").select("caller_symbol_id", F.col("callee_name").alias("callee")).distinct()
    return slim.join(callers, "caller_symbol_id").select("caller", "callee").distinct()


def walk(pairs_of, name: str, depth: int, most: int = 1000) -> DataFrame:
    """caller, callee, distance as `neighbourhood`, from stored adjacency.

    `pairs_of` gives the distinct (caller, callee) rows of a list of names, or all rows for None. A frontier of up to
    `most` names is read by their literals, so that only their part of the table is opened; a larger one is joined.
    Each level is written once and is part of the result; all pairs never are.
    """
    frontier: list[str] | DataFrame = [name]
    found, seen = None, None
    for distance in range(depth + 1):
        if isinstance(frontier, list):
            rows = pairs_of(frontier)
        else:
            rows = pairs_of(None).join(frontier, "caller", "left_semi")
        level = materialize(rows.select("caller", "callee", F.lit(distance).alias("distance")), "level")
        found = level if found is None else found.unionByName(level)
        if distance == depth:
            break
        now = level.sparkSession.createDataFrame([(n,) for n in frontier], "caller string") if isinstance(frontier, list) else frontier
        seen = now if seen is None else seen.unionByName(now)
        following = materialize(
            level.select(F.col("callee").alias("caller")).distinct().join(seen, "caller", "left_anti"), "frontier")
        few = following.limit(most + 1).collect()
        frontier = [r.caller for r in few] if len(few) <= most else following
    return found


def neighbourhood(pairs: DataFrame, name: str, depth: int) -> DataFrame:
    """caller, callee, distance for all callers at most `depth` calls away from the name.

    Breadth first: each level joins the distinct pairs with the names found last, and drops
    names seen before. `pairs` has distinct rows, so a level holds every name once; the
    frontier is checkpointed, which keeps the plan of a level independent of the depth.
    """
    spark = pairs.sparkSession
    pairs = cut_lineage(pairs) if depth > 0 else pairs
    frontier = spark.range(1).select(F.lit(name).alias("caller"))
    seen, found = frontier, None
    for distance in range(depth + 1):
        level = pairs.join(frontier, "caller").withColumn("distance", F.lit(distance))
        found = level if found is None else found.unionByName(level)
        if distance == depth:
            break
        frontier = cut_lineage(
            level.select(F.col("callee").alias("caller")).distinct().join(seen, "caller", "left_anti"))
        seen = seen.unionByName(frontier)
    return found
