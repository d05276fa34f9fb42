import json

import pytest
from pyspark.sql import functions as F

from lodebook import cache, cli, validate
from lodebook.operators import graph, impact, packing, related
from lodebook.operators.ranges import first_range, lines_in_ranges
from lodebook.plans.index import Index, compare, merge_metadata
from lodebook.plans.retriever import Retriever
from lodebook.sources.filetree import read_tree
from lodebook.streaming import incremental

FILES = {
    "src/util.py": "def helper(x):\n    return x\n\n\ndef lonely():\n    return helper(1)\n",
    "src/app.py": "from util import helper\n\nclass App:\n    def run(self):\n        return helper(2)\n",
    "tests/test_app.py": "from app import App\n\ndef test_run():\n    app = App()\n    assert app.run()\n",
    "web/cart.ts": "import { x } from '../src/util';\nexport class Cart {\n  total() {\n    return helper(3);\n  }\n}\n",
    "docs/notes.md": "The helper( function is great.\nnothing\nhelper again\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return root


@pytest.fixture(scope="module")
def retriever(spark, project):
    index = Index(spark, str(project / ".lodebook"))
    report = index.build(read_tree(spark, str(project)))
    assert (report.files_indexed, report.errors) == (5, 0)
    return Retriever(spark, index.folder, str(project))


def test_empty_index(spark, tmp_path):
    r = Retriever(spark, str(tmp_path / "none"))
    total = r.stats()["totals"].first()
    assert (total.file_count, total.symbol_count, total.total_size, total.last_indexed) == (0, 0, 0, None)
    assert r.dependency_graph("x") is None and r.impact_analysis("x") is None


def test_query_and_symbols(retriever):
    found = retriever.query("helper", include_symbols=True, include_imports=True)
    paths = [r.relative_path for r in found.files.collect()]
    assert set(paths) == set(FILES) - {"tests/test_app.py"}
    assert not found.truncated and found.total_tokens > 0
    assert [r.name for r in found.symbols.collect()] == ["helper"]
    first = retriever.find_symbol("helper").first()
    assert (first.name, first.file_path, first.line_start) == ("helper", "src/util.py", 1)
    assert retriever.find_symbol("helper", ["typescript"]).count() == 0
    assert [r.name for r in retriever.find_symbol("Cart.total").collect()] == ["Cart.total"]
    small = retriever.query("helper", max_tokens=1)
    assert small.truncated and small.files.count() == 0 and small.total_tokens == 0
    only = retriever.query("helper", languages=["markdown"], sort_by="path")
    assert [r.relative_path for r in only.files.collect()] == ["docs/notes.md"]
    like = retriever.query("(((")
    assert like.files.count() == 0
    assert "<mark>helper</mark>" in retriever.search_full_text("helper").files.first().snippet


def test_usages(retriever):
    rows = {r.relative_path: r.lines for r in retriever.find_usages("helper").collect()}
    assert rows == {"docs/notes.md": [1], "src/app.py": [5], "web/cart.ts": [4]}


def test_graph(retriever):
    g = retriever.dependency_graph("helper")
    assert [(r.name, r.file_path, r.line) for r in g.root.collect()] == [("helper", "src/util.py", 1)]
    callers = [(r.name, r.file_path, r.call_line) for r in g.called_by.collect()]
    # Prose gives symbols ("function is") and calls as well; a definition line calls itself.
    assert callers == [("is", "docs/notes.md", 1), ("run", "src/app.py", 5), ("helper", "src/util.py", 1),
                       ("lonely", "src/util.py", 6), ("Cart.total", "web/cart.ts", 4)]
    assert {r.callee for r in retriever.call_graph("test_run", 1).collect()} >= {"App", "app.run", "test_run"}
    again = retriever.dependency_graph("helper").called_by.collect()
    assert [r.name for r in again] == [c[0] for c in callers]


def test_impact(retriever):
    found = retriever.impact_analysis("helper")
    s = found.summary.first()
    lines = {r.path: r.lines for r in found.affected_files.collect()}
    assert lines == {"docs/notes.md": [1, 3], "src/app.py": [1, 5], "src/util.py": [1, 6], "web/cart.ts": [4]}
    assert (s.direct_references, s.files_affected, s.tests_affected, s.symbols_affected) == (7, 4, 0, 5)
    assert (s.implementation, s.other, s.risk_score, s.risk_level) == (3, 1, 3, "MEDIUM")
    assert s.risk_factors == ["Some references (7)", "No test coverage detected"]
    plain = retriever.impact_analysis("nothing")
    assert plain.summary.first().location == "not indexed" and plain.summary.first().risk_level == "LOW"
    assert retriever.impact_analysis("absent_everywhere") is None


def test_context_and_related(retriever):
    row = retriever.file_context("src/app.py", include_symbols=True, include_imports=True).first()
    assert row.imports == ["util"] and [s.name for s in row.symbols] == ["App", "run"]
    assert [r.relative_path for r in retriever.related_files("src/app.py").collect()] == ["src/util.py"]
    assert retriever.file_context("missing").count() == 0
    assert "Files indexed: 5" in retriever.context_summary()
    assert retriever.git_history("helper") is None and retriever.recent_changes().isEmpty()


def test_incremental(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def one(): pass\n")
    (root / "b.py").write_text("def two():\n    three()\n")
    index = Index(spark, str(tmp_path / "ix"))
    assert index.build(read_tree(spark, str(root))).files_indexed == 2
    ids = {r.path: r.file_id for r in index.table("files").collect()}
    assert index.build(read_tree(spark, str(root))).files_indexed == 0
    (root / "a.py").write_text("def three(): pass\n")
    (root / "c.py").write_text("x = 1\n")
    assert index.build(read_tree(spark, str(root))).files_indexed == 2
    edge = index.table("call_graph").filter("callee_name = 'three' AND line_number = 2").first()
    assert edge.callee_file_id == ids[str(root / "a.py")]
    (root / "b.py").unlink()
    index.build(read_tree(spark, str(root)))
    assert {r.relative_path for r in index.table("files").collect()} == {"a.py", "c.py"}
    assert {r.name for r in index.table("symbols").collect()} == {"three"}
    assert not index.table("postings").filter("term = 'two'").count()
    assert index.build(read_tree(spark, str(root)), force=True).files_indexed == 2
    index.vacuum()
    assert len(index.versions()) == 1 and index.table("files").count() == 2
    index.clear()
    assert index.version() is None and index.table("files").count() == 0


def test_compare_and_merge(spark):
    scanned = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, hash string")
    assert {tuple(r) for r in compare(scanned, known).collect()} == {
        ("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "deleted")}
    base = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1"})], "id int, metadata map<string,string>")
    patch = spark.createDataFrame([(1, {"b": None, "c": "3"})], "id int, patch map<string,string>")
    assert {r.id: r.metadata for r in merge_metadata(base, patch, "id").collect()} == {1: {"a": "1", "c": "3"}, 2: {"a": "1"}}


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    store = cache.ResultCache(spark, str(tmp_path), "v1")
    assert store.get("q") is None
    assert [tuple(r) for r in store.through("q", rows, 5).collect()] == [("a", 1)]
    assert [tuple(r) for r in store.through("q", rows.limit(0), 5).collect()] == [("a", 1)]
    assert cache.ResultCache(spark, str(tmp_path), "v2").get("q") is None
    store.put("old", rows, -1)
    assert store.get("old") is None
    assert store.purge() == 1 and store.purge() == 0
    assert store.through("none", rows.limit(0), 5).count() == 0 and store.get("none") is not None
    entries = spark.sql("SELECT 'k' AS query_key, timestamp'2024-01-01 00:00:00' AS expires_at")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert cache.live(entries, now).isEmpty()


def test_packing(spark):
    ranked = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "pos int, tokens long")
    assert [r.pos for r in packing.pack(ranked, 9, [F.col("pos")]).collect()] == [1]
    files = spark.createDataFrame([("f1", 1, 5), ("f2", 2, 50)], "item_id string, pos int, tokens long")
    symbols = spark.createDataFrame([("s1", 1, 3), ("s2", 2, 3)], "item_id string, pos int, tokens long")
    plan = packing.pack_two_stage(files, symbols, 10, [F.col("pos")], [F.col("pos")]).collect()
    assert {r.item_id: r.kept for r in plan} == {"f1": True, "f2": False, "s1": True, "s2": False}


def test_neighbourhood_handles_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "caller string, callee string")
    got = {(r.caller, r.callee, r.distance) for r in graph.neighbourhood(pairs, "a", 2).collect()}
    assert got == {("a", "b", 0), ("b", "c", 1), ("c", "a", 2), ("c", "d", 2)}


@pytest.mark.parametrize("refs, files, tests, name, kind, level", [
    (60, 12, 0, "publicApi", "interface", "CRITICAL"), (25, 6, 0, "x", "function", "HIGH"), (6, 1, 0, "x", "class", "MEDIUM"),
    (5, 1, 1, "x", "type", "LOW"), (0, 0, 0, "x", "function", "LOW")])
def test_risk_levels(spark, refs, files, tests, name, kind, level):
    total = spark.createDataFrame([(refs, files, tests)], "direct_references long, files_affected long, tests_affected long")
    assert impact.with_risk(total, F.lit(name), F.lit(kind)).first().risk_level == level


def test_import_targets(spark):
    files = spark.createDataFrame([("1", "src/Util.py"), ("2", "src/util/b.py"), ("3", "x.py")], "file_id string, relative_path string")
    imports = spark.createDataFrame([("util",), ("src/",), ("zzz",), ("",)], "import string")
    got = {(r["import"], r.file_id, r["rank"]) for r in related.import_targets(imports, files).collect()}
    assert got == {("util", "1", 1), ("util", "2", 2), ("src/", "1", 1), ("src/", "2", 2)}
    one = related.imported_files(files, ["util", "nope", "x.py"]).collect()
    assert [(r["import"], r.file_id) for r in one] == [("util", "1"), ("util", "2"), ("x.py", "3")]


def test_validation(capsys):
    for bad in ("0", "-1", "x", ""):
        with pytest.raises(validate.ValidationError):
            validate.positive_int(bad, "--tokens")
    assert validate.positive_int("200000", "--tokens") == 200000 and "200000" in capsys.readouterr().err
    for check, bad in ((validate.output_format, "xml"), (validate.search_term, "a"), (validate.search_term, " "), (validate.path, " ")):
        with pytest.raises(validate.ValidationError):
            check(bad)
    assert validate.languages("ts, py", {"ts": "typescript", "py": "python"}) == ["typescript", "python"]


def test_command_line(spark, project, capsys, tmp_path):
    where = ["--project", str(project), "--index", str(tmp_path / "ix")]
    run = lambda *a: (cli.main([*where, *a], spark), capsys.readouterr().out)
    code, out = run("index", str(project), "--quiet")
    assert code == 0 and json.loads(out)["indexed"] == 5
    _, out = run("query", "helper", "--format", "json", "--impact", "--show-graph", "--include-callers", "--recent", "7")
    data = json.loads(out)
    assert data["primarySymbol"]["name"] == "helper" and len(data["usages"]) == 3
    assert data["impactAnalysis"]["directReferences" if "directReferences" in data["impactAnalysis"] else "direct_references"] == 7
    assert len(data["dependencyGraph"]["calledBy"]) == 5 and data["recentChanges"] == []
    _, out = run("query", "helper", "--impact", "--show-graph", "--include-callers", "--include-tests")
    for part in ("# Context for: helper", "## helper (function)", "### Found in Files", "### Called By", "Risk Level: MEDIUM",
                 "### Text References", "### Token Usage"):
        assert part in out
    _, out = run("query", "helper", "--format", "human")
    assert "Primary Match" in out and "Summary" in out
    _, out = run("stats", "--json")
    assert json.loads(out)["files"] == 5
    _, out = run("stats", "--detailed")
    assert "Total files: 5" in out and "python" in out
    assert run("query", "x")[0] == 1
    assert "--force" in run("clear")[1]
    run("clear", "--force")
    assert json.loads(run("stats", "--json")[1])["status"] == "empty"


def test_stream_of_versions(spark, tmp_path):
    schema = "path string, relative_path string, content string, size long, last_modified timestamp"
    source, index = str(tmp_path / "in"), Index(spark, str(tmp_path / "ix"))

    def arrive(*rows):
        spark.createDataFrame([(p, p, c, len(c)) for p, c in rows], "path string, relative_path string, content string, size long") \
            .withColumn("last_modified", F.current_timestamp()).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.keep_indexed(stream, index, str(tmp_path / "cp")).awaitTermination()

    arrive(("a.py", "def a(): pass"), ("b.py", "def b(): pass"))
    arrive(("a.py", "def a2(): pass"))
    assert {r.name for r in index.table("symbols").collect()} == {"a2", "b"}


def test_failed_and_unreadable_files(spark):
    known = spark.createDataFrame([("a", "1", None), ("b", "2", "broken"), ("c", "3", None)], "path string, hash string, error string")
    scanned = spark.createDataFrame(
        [("a", None, "denied"), ("b", "2", None), ("c", "3", None), ("d", None, "denied")], "path string, hash string, error string")
    states = {r.path: r.state for r in compare(scanned, known).collect()}
    assert states == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "unreadable"}


def test_unreadable_file_keeps_its_old_rows(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name in ("a.py", "b.py"):
        (tmp_path / "p" / name).write_text(f"def {name[0]}():\n    pass\n")
    index = Index(spark, str(tmp_path / "ix"))
    index.build(read_tree(spark, str(tmp_path / "p")))
    again = read_tree(spark, str(tmp_path / "p"))
    lost = again.withColumn("error", F.when(F.col("relative_path") == "a.py", "denied")).withColumn(
        "hash", F.when(F.col("relative_path") != "a.py", F.col("hash")))
    assert index.build(lost).errors == 1
    assert sorted(r.relative_path for r in index.table("files").collect()) == ["a.py", "b.py"]
    assert {r.name for r in index.table("symbols").collect()} == {"a", "b"}


def test_one_line_file_makes_no_pairs(spark):
    """A line with very many calls and symbols is one point and one range."""
    points = spark.createDataFrame([("f", 1, k) for k in range(3000)], "file_id string, line int, call int")
    ranges = spark.createDataFrame([("f", 1, 1, k, k) for k in range(3000)], "file_id string, range_start int, range_end int, no int, first int")
    found = first_range(points, ranges, "no", "first")
    assert found.count() == 3000 and found.select("first").distinct().collect()[0][0] == 0
    assert lines_in_ranges(points.select("file_id", "line").distinct(), ranges.groupBy("file_id", "range_start", "range_end").agg(
        F.min("no").alias("no"))).count() == 1
