"""Added extractors: order, failure of one, failure of all, and what an index makes of them."""

import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodebook.operators import extraction
from lodebook.operators.extractors import REGISTRY, Extractor, Found, Registry
from lodebook.plans.index import Index
from lodebook.sources.filetree import with_derived

# Workers do not have this file, as they would not have a caller's script.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASKS = "# build it\ntask build\n  run compile.all\nend\ntask test\n  run build\nend\n"


def tasks(language, content):
    for m in re.finditer(r"^task (\w+)[\s\S]*?^end$", content, re.M):
        yield Found("function", m.group(1), m.start(), m.start() + 5 + len(m.group(1)), last=m.end())
    for m in re.finditer(r"\brun ([\w.]+)", content):
        yield Found("call_method" if "." in m.group(1) else "call_function", m.group(1), m.start(1), m.end())
    for m in re.finditer(r"^#.*$", content, re.M):
        yield Found("comment", "", m.start(), m.end())


def broken(language, content):
    yield Found("function", "half", 0, 1)
    raise RuntimeError("cannot read this")


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id string, language string, content string")


def names(matches):
    return sorted((r.file_id, r.name, r.line_start, r.line_end, r.signature) for r in extraction.symbols_of(matches).collect())


def test_order_of_a_chain():
    def none(language, content):
        return []

    special, late, wide = Extractor("a", none, ("python",), 20), Extractor("b", none, ("python", "x"), 5), Extractor("c", none, (), 99)
    registry = Registry()
    for e in (wide, late, special):
        registry.register(e)
    assert registry.chain("python", 10) == [special, None, late, wide]
    assert registry.chain("x", 1) == [late, wide, None]
    assert registry.chain("other", 1) == [wide, None]
    assert registry.languages() == ["python", "x"]
    registry.register(Extractor("a", none, ("z",), 1))
    assert registry.chain("python", 10) == [None, late, wide]


def test_a_caller_adds_a_language(spark):
    registry = Registry([Extractor("tasks", tasks, ("tasklang",), 20)])
    frame = files(spark, [("t", "tasklang", TASKS), ("p", "python", "def f():\n    return g()\n")])
    matches = extraction.find_matches(frame, registry=registry)
    assert names(matches) == [("p", "f", 1, 3, "def f()"), ("t", "build", 2, 4, "task build"), ("t", "test", 5, 7, "task test")]
    calls = {(r.callee_name, r.call_type, r.line_number) for r in extraction.calls_of(matches).filter("file_id = 't'").collect()}
    assert calls == {("compile.all", "method", 3), ("build", "function", 6)}
    assert [r.comment for r in extraction.comments_of(matches).filter("file_id = 't'").collect()] == ["# build it"]
    only = extraction.find_matches(frame, ("comment",), registry)
    assert {r.kind for r in only.collect()} == {"comment"}


def test_a_failing_one_is_followed_by_the_next(spark):
    rows = [("t", "tasklang", TASKS), ("p", "python", "def f():\n    return g()\n")]
    first = Extractor("broken", broken, ("tasklang", "python"), 30)
    matches = extraction.find_matches(files(spark, rows), registry=Registry([first, Extractor("tasks", tasks, ("tasklang",), 20)]))
    assert [r[:2] for r in names(matches)] == [("p", "f"), ("t", "build"), ("t", "test")]
    assert matches.filter("kind = 'error'").count() == 0


def test_the_general_rules_remain(spark):
    def bad_kind(language, content):
        yield Found("nonsense", "x", 0, 1)

    registry = Registry([Extractor("broken", broken, (), 30), Extractor("bad", bad_kind, (), 20)])
    found = extraction.find_matches(files(spark, [("a", "nolang", "# note\ndef f(): pass\n")]), registry=registry)
    assert [r[1] for r in names(found)] == ["f"]  # both fail, the general rules remain


def test_comments_are_left_when_all_fail(monkeypatch):
    def fail(file_id, language, content, rules, find=extraction.file_matches):
        if any(rule.kind != "comment" for _, rule, _ in rules):
            raise RuntimeError("no rules today")
        return find(file_id, language, content, rules)

    monkeypatch.setattr(extraction, "file_matches", fail)
    find = extraction.match_chain(Registry([Extractor("broken", broken, (), 30)]), None)
    rows = find("a", "python", "# note\ndef f(): pass\n")
    assert [(r[2], r[8]) for r in rows] == [("error", ""), ("comment", "# note")]
    assert "no rules today" in rows[0][-1]  # the first failure is told


def test_wrong_results_count_as_failure(spark):
    def outside(language, content):
        yield Found("function", "x", 5, 10_000)

    found = extraction.find_matches(files(spark, [("a", "python", "def f(): pass\n")]), registry=Registry([Extractor("o", outside, ("python",), 30)]))
    assert [r[1] for r in names(found)] == ["f"]


@pytest.fixture
def registered():
    REGISTRY.register(Extractor("tasks", tasks, ("unknown",), 20))
    yield
    REGISTRY.unregister("tasks")


def test_an_index_uses_the_common_registry(spark, tmp_path, registered):
    rows = [("a.tasks", "a.tasks", TASKS, len(TASKS))]
    scan = with_derived(spark.createDataFrame(rows, "path string, relative_path string, content string, size long").withColumn(
        "last_modified", F.lit("2024-01-01").cast("timestamp"))).withColumn("language", F.lit("unknown"))
    index = Index(spark, str(tmp_path))
    index.build(scan)
    assert {r.name for r in index.table("symbols").collect()} == {"build", "test"}
    edges = {(r.callee_name, r.callee_symbol_id is not None) for r in index.table("call_graph").collect()}
    assert edges == {("compile.all", False), ("build", True)}
