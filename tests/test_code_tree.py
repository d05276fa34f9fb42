"""Call graphs in parts, and files that are dealt out over tasks."""

from pyspark.sql import functions as F

from lodebook.operators import graph, resolve
from lodebook.plans.catalogue import languages

SYMBOL = "symbol_id string, file_id string, name string, line_start int, line_end int"
CALL = "call_id string, file_id string, callee_name string, call_type string, line_number int, column_number int"


def number(n):
    return f"{n:021d}"


def tables(spark):
    """Two files with a class, methods and calls; the rows of the second file stand twice."""
    symbols = [(f"a#{number(1)}", "a", "Box", 1, 9), (f"a#{number(2)}", "a", "Box.load", 2, 4), (f"a#{number(3)}", "a", "run", 5, 6)]
    again = [(f"b#{number(1)}", "b", "run", 1, 4), (f"b#{number(2)}", "b", "load", 3, 3), (f"b#{number(3)}", "b", "run", 1, 8)]
    called = [("a", "x.load", 3), ("a", "run", 5), ("a", "gone", 5), ("b", "Box", 2), ("b", "load", 3), ("b", "q.run", 7), ("c", "load", 1), ("c", "run", 1)]
    calls = [(f"{f}#{number(100 + i)}", f, name, "function", line, 1) for i, (f, name, line) in enumerate(called)]
    return spark.createDataFrame(calls + [c for c in calls if c[1] == "b"], CALL), spark.createDataFrame(symbols + again + again, SYMBOL)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_resolved_names(spark):
    calls, symbols = tables(spark)
    names = symbols.select(F.col("symbol_id").alias("callee_symbol_id"), F.col("name").alias("resolved_name"))
    expected = resolve.callees_of(calls, symbols).join(names, "callee_symbol_id").select(*calls.columns, "callee_file_id", "resolved_name")
    found = resolve.resolved_names(calls, symbols)
    assert rows(found) == rows(expected) and any("Box.load" in r for r in rows(found))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < expected._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_caller_names_and_pairs(spark):
    calls, symbols = tables(spark)
    whole = resolve.call_graph(calls, symbols)
    names = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller"))
    expected = whole.join(names, "caller_symbol_id", "left").select("caller_file_id", "line_number", "callee_name", "caller")
    found = calls.join(resolve.caller_names(calls, symbols), ["file_id", "line_number"], "left").select(
        "file_id", "line_number", "callee_name", "caller")
    assert rows(found) == rows(expected)
    assert rows(resolve.named_pairs(calls, symbols)) == rows(graph.named_edges(whole, symbols))


def test_part_of_call_graph(spark):
    calls, symbols = tables(spark)
    whole = resolve.call_graph(calls, symbols)
    for part in (F.col("callee_name").isin("x.load", "load"), F.col("callee_name").endswith("run")):
        assert rows(resolve.part_of_call_graph(calls.filter(part), symbols)) == rows(whole.filter(part))


def test_files_of_a_small_table_are_dealt_out(spark, tmp_path):
    """One row group is one task; extraction costs about a millisecond for each file, and runs once."""
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(1, 300).select(F.col("id").alias(key)).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    for files in (languages.scope_files, languages.language_files):
        assert files(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for query in (languages.symbols, languages.scope_symbols, languages.scope_members):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan
