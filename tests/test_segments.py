"""The log-structured index: what a build writes, that nothing differs from a full build, merging and upkeep."""

import re

import pytest
from pyspark.sql import functions as F

from lodebook import schema
from lodebook.operators import grams, resolve
from lodebook.plans import segments
from lodebook.plans.index import Index
from lodebook.plans.retriever import Retriever
from lodebook.plans.segments import ConcurrentChange, SegmentStore
from lodebook.sources.filetree import with_derived
from lodebook.streaming import incremental

FIRST = {
    "a.py": "def one():\n    return two()\n",
    "b.py": "def two():\n    return three(1)\n\nclass Box:\n    def open(self):\n        return one()\n",
    "c.ts": "export class Cart {\n  open() {\n    return two(3);\n  }\n}\n",
    "d.py": "import b\n\ndef four():\n    return open() + five()\n",
}
SECOND = {
    "b.py": "def two():\n    return 2\n",  # Box.open goes
    "c.ts": None,
    "e.py": "def three(x):\n    return five()\n",
    "0.py": "def five():\n    return two()\n",
}


def scan(spark, files):
    rows = [(p, p, c, len(c)) for p, c in files.items()]
    return with_derived(spark.createDataFrame(
        rows, "path string, relative_path string, content string, size long").withColumn("last_modified", F.lit("2024-01-01").cast("timestamp")))


def after(*changes):
    files: dict = {}
    for change in changes:
        files.update(change)
    return {p: c for p, c in files.items() if c is not None}


def contents(index):
    """All rows of all tables of the last version, as sets of text."""
    found = {}
    for name in ("files", "symbols", "comments", "call_graph", "definitions", "sizes", "postings", "symbol_postings"):
        rows = index.table(name).drop("bucket", "indexed_at")
        found[name] = sorted(str(r) for r in rows.collect())
    return found


def segments_of(index):
    return [s["id"] for s in index.store.manifest(index.version())["segments"]]


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("twice")))
    index.build(scan(spark, FIRST))
    report = index.build(scan(spark, after(FIRST, SECOND)))
    assert (report.files_indexed, report.errors) == (3, 0)
    return index


def test_equal_to_a_full_build(spark, twice, tmp_path):
    full = Index(spark, str(tmp_path))
    full.build(scan(spark, after(FIRST, SECOND)))
    assert contents(twice) == contents(full)
    for kind in ("files", "symbols"):
        assert twice.corpus(kind) == full.corpus(kind)
    for term in ("two", "return", "three OR five", "def NOT one"):
        rows = [[(r.relative_path, r.preview) for r in Retriever(spark, i.folder).query(term).files.collect()] for i in (twice, full)]
        assert rows[0] == rows[1] and rows[0]


def test_second_segment_has_the_change_only(twice):
    last = segments_of(twice)[1]
    assert {r.path for r in twice.store.read("files", [last]).collect()} == {"b.py", "e.py", "0.py"}
    ids = {r.file_id for r in twice.store.read("files", [last]).collect()}
    for name in ("symbols", "comments", "definitions", "sizes", "postings"):
        assert {r.file_id for r in twice.store.read(name, [last]).collect()} <= ids
    assert twice.store.read("dead_files", [last]).count() == 2  # b.py and c.ts


def test_only_edges_of_changed_names_are_resolved_again(twice):
    last = segments_of(twice)[1]
    paths = {r.file_id: r.path for r in twice.table("files").collect()}
    rows = [(paths[r.caller_file_id], r.callee_name, paths.get(r.callee_file_id)) for r in twice.store.read("call_graph", [last]).collect()]
    old = sorted(r for r in rows if r[0] in ("a.py", "d.py"))
    # a.py calls two(), still in b.py; d.py calls open(), which is gone, and five(), which came.
    assert old == [("d.py", "five", "0.py"), ("d.py", "open", None)]
    assert twice.store.read("dead_edges", [last]).count() == 2


def test_nothing_to_do_writes_nothing(spark, twice):
    before = (twice.versions(), twice.store.names("files"), twice.store.names("dead_files"), twice.store.names("work"))
    assert twice.build(scan(spark, after(FIRST, SECOND))).files_indexed == 0
    assert (twice.versions(), twice.store.names("files"), twice.store.names("dead_files"), twice.store.names("work")) == before


def test_old_version_stays_readable(twice):
    first = twice.versions()[0]
    assert {r.path for r in twice.table("files", first).collect()} == set(FIRST)
    assert {r.name for r in twice.table("symbols", first).collect()} >= {"Cart", "Cart.open", "Box"}


def test_changed_winners(spark):
    def winners(*rows):
        return resolve.winners_of(spark.createDataFrame(rows, "name string, file_id string, rank long").withColumn(
            "rank", F.col("rank").cast("decimal(23,0)")))

    before = winners(("x", "f2", 1), ("y", "f1", 1), ("z", "f1", 1))
    now = winners(("x", "f2", 1), ("x", "f9", 1), ("y", "f1", 5), ("w", "f3", 1))
    # A further definition of x that does not win changes nothing.
    assert {r.name for r in resolve.changed_names(before, now).collect()} == {"y", "z", "w"}


def test_many_small_changes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 2)
    index, files = Index(spark, str(tmp_path / "many")), dict(FIRST)
    index.build(scan(spark, files))
    for k in range(2):
        files[f"m{k}.py"] = f"def made_{k}():\n    return two() + made_{k - 1}()\n"
        files["a.py"] = f"def one():\n    return made_{k}()\n"
        incremental.upsert(index, scan(spark, {p: files[p] for p in (f"m{k}.py", "a.py")}).drop("hash", "language"))
    assert len(segments_of(index)) == 1
    full = Index(spark, str(tmp_path / "full"))
    full.build(scan(spark, files))
    expected = contents(full)
    assert contents(index) == expected and index.corpus("files") == full.corpus("files")
    index.vacuum(grace_hours=0)
    assert contents(index) == expected and len(index.versions()) == 1
    assert len(index.store.names("files")) == len(segments_of(index))
    with pytest.raises(ValueError):
        index.vacuum(keep=0)


def test_second_writer_fails(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path))
    first = store.commit(None, {"segments": [], "corpus": {}})
    assert store.commit(first, {"segments": [], "corpus": {}}) != first
    with pytest.raises(ConcurrentChange):
        store.commit(first, {"segments": [], "corpus": {}})
    assert len(store.versions()) == 2 and not [n for n in store.names("manifests") if n.startswith("draft")]


def test_failed_builds_leave_nothing_for_good(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.build(scan(spark, {"a.py": "def a(): pass\n"}))
    segment = index.store.new_segment()
    index.store.save("dead_files", segment, spark.createDataFrame([("x", "y")], schema.DEAD_FILES))
    assert all(index.store.columns(n) == spark.createDataFrame([], c).columns for n, c in schema.TABLES.items())
    index.store.work("state", segment, spark.range(1))
    index.vacuum()
    assert f"segment={segment}" in index.store.names("dead_files")  # may be a running build
    index.vacuum(grace_hours=0)
    assert f"segment={segment}" not in index.store.names("dead_files") and not index.store.names("work")
    assert index.table("files").count() == 1


def grams_by_hand(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return {(a << 16) | (b << 8) | c for a, b, c in zip(data, data[1:], data[2:])}


def test_grams(spark, monkeypatch):
    texts = {"00": "Hello Wörld", "01": "", "02": "ab", "10": "hello hello", "11": None, "20": "x" * 5000 + "Hello"}
    files = spark.createDataFrame(list(texts.items()), "file_id string, content string").repartition(3)
    monkeypatch.setattr(grams, "SPAN", 100)
    for digits in (0, 1, 2):
        expected = {(g, i[:digits]) for i, t in texts.items() for g in grams_by_hand(t or "")}
        rows = [(r.gram, r.block) for r in grams.build(files, digits).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected
    assert set(grams.grams_of("WöR")) == grams_by_hand("wör") and grams.grams_of("ab") == []
    assert set(grams.grams_of("abc%de_fgh", wildcards=True)) == grams_by_hand("abc") | grams_by_hand("fgh")
    assert [grams.digits_of(n) for n in (0, 1 << 20, 1 << 21, 1 << 24, 1 << 30)] == [0, 0, 1, 1, 3]


def test_candidates_have_every_hit_and_few_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "BLOCK_BYTES", 300)
    index = Index(spark, str(tmp_path))
    files = {f"f{k}.py": f"def rare{k:04d}():\n    return common(value_{k % 7})\n" for k in range(120)}
    index.build(scan(spark, files))
    files.update({f"f{k}.py": f"def other_{k}():\n    return Common(Value_{k % 7})\n" for k in range(30)})
    index.build(scan(spark, files))
    for term in ("rare0077", "RARE00_7", "common", "value_3", "Value_3", "n", "absent", "r(", "other_1"):
        for monkey_ranges in (200, 1):
            monkeypatch.setattr(segments, "MOST_RANGES", monkey_ranges)
            chosen = {r.path for r in index.files_with(term, wildcards=True).collect()}
            pattern = re.escape(term.lower()).replace("_", ".")
            assert chosen >= {p for p, c in files.items() if re.search(pattern, c.lower())}
            if term in ("rare0077", "absent"):
                assert len(chosen) < 12
    found = Retriever(spark, index.folder).impact_analysis("rare0077")
    assert [r.path for r in found.affected_files.collect()] == ["f77.py"]


def test_only_blocks_with_the_term_are_read(spark, tmp_path, monkeypatch):
    """Rows that leave the scan of the files, counted by the accumulator of the plan."""
    monkeypatch.setattr(grams, "BLOCK_BYTES", 1000)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.page.row.count.limit", "20")
    try:
        index = Index(spark, str(tmp_path))
        index.build(scan(spark, {f"f{k}.py": f"def rare{k:04d}():\n    return common({k})\n" for k in range(2000)}))
    finally:
        hadoop.unset("parquet.page.row.count.limit")

    def rows_read(frame):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            frame = frame.select("path", "content")
            plan = frame._jdf.queryExecution().executedPlan()
            frame._jdf.queryExecution().toRdd().count()
            leaf = plan.collectLeaves().head()
            return leaf.metrics().apply("numOutputRows").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    assert rows_read(index.table("files")) == 2000
    assert rows_read(index.files_with("rare1234")) < 600
