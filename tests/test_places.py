"""Lines and names that are looked up where the rows of a file lie side by side."""

import random

from pyspark.sql import functions as F

from lodebook.functions import rules
from lodebook.operators import extraction, ranges, resolve
from lodebook.plans.index import Index
from lodebook.sources import codetree
from tests.test_code_tree import number, rows, tables
from tests.test_parts import scan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_range_joins_points_once(spark):
    rng = random.Random(5)
    around = [("f", a, a + rng.choice([-1, 0, 3, 40, 255, 700]), k) for k, a in enumerate(rng.choices(range(1, 900), k=60))]
    points = spark.createDataFrame([(f, line, k) for k, (f, line) in enumerate([(f, n) for f in "fg" for n in range(0, 1700, 3)] * 2)],
                                   "file_id string, line int, call int")
    found = ranges.first_range(points, spark.createDataFrame(
        [(f, a, z, k, f"n{k}") for f, a, z, k in around], "file_id string, range_start int, range_end int, no int, name string"), "no", "name")
    expected = [(f, n, c, next((f"n{k}" for g, a, z, k in around if g == f and a <= n <= z), None)) for f, n, c in map(tuple, points.collect())]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    plan = plan_of(found)
    assert plan.count("Join") == 1 and "min_by" not in plan


def test_stretches_do_not_overlap(spark):
    many = spark.createDataFrame([("f", k % 300, 600 - k % 7, k) for k in range(4000)], "file_id string, range_start int, range_end int, no int")
    found = sorted((r.range_start, r.range_end) for r in ranges.stretches(many, "no", "no").collect())
    assert all(a <= b for a, b in found) and all(b < c for (_, b), (c, _) in zip(found, found[1:]))
    assert found[0][0] == 0 and found[-1][1] == 600


def test_caller_names_of_every_call(spark):
    calls, symbols = tables(spark)
    expected = calls.join(resolve.caller_names(calls, symbols), ["file_id", "line_number"], "left").select(
        "file_id", "line_number", "callee_name", "call_id", "caller")
    found = resolve.caller_names(calls, symbols, ["callee_name", "call_id"])
    assert rows(found) == rows(expected) and any(r.caller is None for r in found.collect())
    assert plan_of(found).count("Join") == 1


def test_calls_are_resolved_in_their_file_first(spark):
    calls, symbols = tables(spark)
    calls, symbols = calls.distinct(), symbols.distinct()
    own = resolve.definitions_of(symbols)
    placed = resolve.calls_in_place(calls, symbols, own)
    found = resolve.resolve_in_place(placed, resolve.winners_of(own)).withColumns(resolve.edge_columns())
    whole = resolve.call_graph(calls, symbols)
    assert rows(found.select(*whole.columns)) == rows(whole)
    # Two joins find the callers and the callees of all calls; one more, of the few hot names, is with each side of the second.
    assert plan_of(placed).count("Join") == 1
    assert {r.callee_name for r in placed.filter("own_rank IS NOT NULL").collect()} == {"x.load", "run", "load", "q.run"}
    bare = resolve.calls_in_place(calls, symbols)
    assert rows(bare) == rows(placed.withColumn("own_rank", F.lit(None).cast("decimal(23,0)")).select(*bare.columns))


def test_live_edges_lose_dead_rows_by_one_join(spark, tmp_path):
    files = {f"{a}.py": f"def {a}():\n    return {b}() + {c}()\n" for a, b, c in ("pqr", "qrp", "rpp")}
    index, fresh = Index(spark, str(tmp_path), only=("call_graph",)), Index(spark, str(tmp_path / "fresh"), only=("call_graph",))
    index.build(scan(spark, files))
    files["p.py"] = "def other():\n    return q()\n"
    for one in (index, fresh):
        one.build(scan(spark, files))
    edges = index.table("call_graph")
    assert rows(edges) == rows(fresh.table("call_graph")) != []
    assert any(s["dead_edges"] for s in index.store.manifest(index.version())["segments"])
    assert plan_of(edges).count("LeftAnti") == 1


def test_files_without_what_a_rule_needs_are_not_searched():
    texts = ["def f(a):\n  return new G(a).h(1)\n", "const a = (x) => y\ntype T = { b: 1 }\nexport default a", "f = lambda x: x.y\n", "plain words", ""]
    wanted = {rule for group in rules.rules_by_language().values() for rule in group if rule.needs}
    assert {"lambda", "def", "(", "=>", "new"} <= {rule.needs for rule in wanted}

    class Never:
        def finditer(self, text):
            raise AssertionError("searched")

    for language in ("python", "typescript", "go", ""):
        for text in texts:
            compiled = extraction.compiled_rules(language)
            found = extraction.file_matches("f", language, text, compiled)
            guarded = [(i, rule, Never() if rule.needs and rule.needs not in (extraction.mask_js(text)[0] if rule.masked else text) else regex) for i, rule, regex in compiled]
            assert extraction.file_matches("f", language, text, guarded) == found
            everything = [(i, rule._replace(needs=""), regex) for i, rule, regex in compiled]
            assert extraction.file_matches("f", language, text, everything) == found


def test_definitions_are_found_once_for_all_calls(spark):
    calls, symbols = tables(spark)
    plan = plan_of(resolve.resolved_names(calls, symbols))
    assert "Union" not in plan and "decimal" not in plan
    assert number(3) == symbols.select(extraction.order_text("symbol_id").alias("n")).agg(F.max("n")).first()[0]


def test_filled_is_format_string(spark):
    table = spark.createDataFrame([(1, -2, "O"), (None, 10 ** 12, None), (7, None, "%1$d")], "o_custkey long, o_orderkey long, o_orderstatus string")
    names = ("o_custkey", "o_orderkey", "o_orderstatus")
    filled = codetree.filled(codetree.PYTHON_FILE, *names)
    assert "format_string" not in plan_of(table.select(filled))
    assert table.filter(filled.eqNullSafe(F.format_string(codetree.PYTHON_FILE, *names))).count() == 3
