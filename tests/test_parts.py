"""Indexes that keep only some tables, postings that are written where texts are read, imports looked up without a shuffle of paths."""

import os

import pytest
from pyspark.sql import functions as F

from lodebook.operators import extraction, postings, ranges, related
from lodebook.plans import index as index_module
from lodebook.plans.index import Index
from lodebook.sources.filetree import with_derived

FILES = {
    "a.py": "def one():\n    return two()\n", "b.py": "# note\nclass Box(Base):\n    size = 1\n    def open(self):\n        return one()\n",
    "c.ts": "import { x } from './a';\nexport class Cart {\n  open() {\n    return two(3);\n  }\n}\n",
}
CHANGE = {"a.py": "def two():\n    return 2\n", "c.ts": None, "d.py": "def one():\n    return open()\n"}


def scan(spark, files):
    rows = [(p, p, c, len(c)) for p, c in files.items() if c is not None]
    return with_derived(spark.createDataFrame(
        rows, "path string, relative_path string, content string, size long").withColumn("last_modified", F.lit("2024-01-01").cast("timestamp")))


def rows_of(index, name):
    return sorted(str(r) for r in index.table(name).drop("indexed_at").collect())


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("whole")))
    for files in (FILES, {**FILES, **CHANGE}):
        index.build(scan(spark, files))
    return index


@pytest.mark.parametrize("parts", [("call_graph",), ("symbols", "comments"), ("postings", "grams")])
def test_parts_are_those_of_a_whole_index(spark, tmp_path, whole, parts):
    index = Index(spark, str(tmp_path), only=parts)
    for files in (FILES, {**FILES, **CHANGE}):
        index.build(scan(spark, files))
    for name in parts:
        if name != "grams":
            assert rows_of(index, name) == rows_of(whole, name) != []
    assert sorted(r.relative_path for r in index.files_with("two").collect()) if "grams" in parts else True
    assert index.corpus("files") == whole.corpus("files")
    missing = index_module.PARTS - index.parts() - {"details"}
    assert missing and not any(os.path.exists(tmp_path / name) for name in missing)
    assert Index(spark, str(tmp_path)).parts() == index.parts()
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path), only=("comments",)).build(scan(spark, FILES))
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path), only=("colours",))


def test_postings_are_written_in_sorted_runs_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RUN_TOKENS", 40)
    monkeypatch.setattr(postings, "ROWS_OUT", 7)
    texts = [(k, f"{k}.txt", " ".join(f"w{(k * j) % 11}" for j in range(k % 9))) for k in range(60)]
    files = spark.createDataFrame(texts, "file_id long, relative_path string, content string").coalesce(2)
    built = postings.build(files, columns=("content",))
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    expected = {}
    for k, _, text in texts:
        for at, word in enumerate(text.split()):
            expected.setdefault((word, k), []).append(at)
    got = built.collect()
    assert {(r.term, r.file_id): list(r.positions) for r in got} == expected and len(got) == len(expected)
    assert {r.file_id: r.doc_length for r in got} == {k: len(t.split()) for k, _, t in texts if t}
    postings.write(built, str(tmp_path / "p"))
    assert len([f for f in os.listdir(tmp_path / "p") if f.endswith(".parquet")]) <= 2
    falls = sum(a.term > b.term for a, b in zip(got, got[1:]))
    assert 0 < falls < sum(len(t.split()) for _, _, t in texts) // 40 + 2


def test_few_imports_leave_the_paths_where_they_are(spark):
    paths = [f"src/{'ab'[k % 2]}/File_{k}.py" for k in range(500)]
    files = spark.createDataFrame([(p, p) for p in paths], "file_id string, relative_path string")
    imports = ["file_1", "a/F", "_9", "%", "zzz", "\\"]
    found = related.import_targets(spark.createDataFrame([(i,) for i in imports], "import string"), files)
    got = sorted((r["import"], r["file_id"], r["rank"]) for r in found.collect())

    def first(test):
        return sorted(p for p in paths if test(p.lower()))[:5]

    tests = {"file_1": lambda p: "file_1" in p, "a/F": lambda p: "a/f" in p, "_9": lambda p: any(c == "9" for c in p[1:]),
             "%": lambda p: True, "zzz": lambda p: False, "\\": lambda p: False}
    assert got == sorted((i, p, n) for i, t in tests.items() for n, p in enumerate(first(t), 1))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_members_of_many_matches_are_spread_over_more_tasks(spark, monkeypatch):
    files = scan(spark, FILES).withColumn("file_id", F.col("path"))
    matches = extraction.find_matches(files).localCheckpoint()
    symbols = extraction.symbols_of(matches)

    def members(tasks):
        found = extraction.with_members(symbols, extraction.class_members(matches, symbols, tasks), tasks)
        return sorted(str(r) for r in found.collect()), found.rdd.getNumPartitions()

    assert ranges.tasks_for(matches, matches.count()) is None
    monkeypatch.setattr(ranges, "ROWS_PER_TASK", 1)
    tasks = ranges.tasks_for(matches, matches.count())
    assert tasks == matches.count() > 8
    assert members(tasks)[0] == members(None)[0] and members(tasks)[1] == tasks


def test_files_without_text_are_treated_alike(spark, tmp_path):
    def corpus(folder, only):
        index = Index(spark, str(tmp_path / folder), only=only)
        files = scan(spark, {"a.txt": "one two", "b.txt": "three"})
        none = files.filter("path = 'b.txt'").withColumns({"path": F.lit("n.txt"), "content": F.lit(None).cast("string"), "hash": F.lit(None).cast("string")})
        for more in (files, files.filter("path = 'a.txt'").withColumn("hash", F.lit("x"))):
            index.build(more.unionByName(none))
        return index.corpus("files")

    assert corpus("postings", ("postings",)) == corpus("whole", None)
