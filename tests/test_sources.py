import datetime
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodebook.functions.rules import CATEGORIES, REGEX_LANGUAGES
from lodebook.operators import history
from lodebook.sources import filetree, gitlog, languages
from lodebook.sources.ignore import DEFAULT_PATTERNS, ignored


@pytest.fixture()
def tree(tmp_path):
    files = {
        "index.ts": "export const a = 1;", "test.js": "function t() {}", "README.md": "# hi", "src/main.ts": "main()",
        "src/utils.ts": "x", "src/__init__.py": "", ".gitignore": "node_modules/\n*.log\n", "debug.log": "no",
        "node_modules/package.json": "{}", "large.txt": "y" * 1000, "bad.bin": b"\xff\xfeok",
        "a/dist/out.js": "no", ".lodebook/v1/x": "no", "Dockerfile": "FROM x",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


def test_tree_scan(spark, tree):
    rows = {r.relative_path: r for r in filetree.read_tree(spark, tree).collect()}
    assert set(rows) == {"index.ts", "test.js", "README.md", "src/main.ts", "src/utils.ts", "src/__init__.py",
                         ".gitignore", "large.txt", "bad.bin", "Dockerfile"}
    assert rows["index.ts"].language == "typescript" and rows["test.js"].language == "javascript"
    assert rows["README.md"].language == "markdown" and rows["Dockerfile"].language == "dockerfile"
    assert rows["bad.bin"].language is None and rows["bad.bin"].content == "��ok"
    assert len(rows["index.ts"].hash) == 64


def test_include_and_size(spark, tree):
    names = lambda **o: {r.relative_path for r in filetree.read_tree(spark, tree, **o).select("relative_path").collect()}
    assert names(include=["typescript"]) == {"index.ts", "src/main.ts", "src/utils.ts"}
    assert "large.txt" not in names(max_file_size=500)
    assert "a/dist/out.js" in names(ignore=[]) and "debug.log" not in names(ignore=[])


def test_ignore_rules_on_a_column(spark):
    cases = {
        "node_modules/a.js": True, "a/node_modules/b/c.js": True, "src/env/x": True, "out/x": True, "a/out/x": False,
        "x.min.js": True, "a/b.pyc": True, "env.ts": False, "src/a.ts": False, "yarn.lock": True,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.i for r in df.select("p", ignored(F.col("p"), DEFAULT_PATTERNS).alias("i")).collect()} == cases
    rules = ["*.log", "!keep.log", "/top/", "doc/*.txt", "a?c", "[xy].md", "# note", "", "logs/**/deep"]
    cases = {
        "a.log": True, "keep.log": False, "top/f": True, "b/top/f": False, "top": False, "doc/a.txt": True,
        "doc/b/a.txt": False, "abc": True, "ac": False, "x.md": True, "z.md": False, "logs/deep": True, "logs/1/2/deep/f": True,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.i for r in df.select("p", ignored(F.col("p"), rules).alias("i")).collect()} == cases


def test_language_lists(spark):
    assert languages.supported_extensions(spark).count() == len(languages.LANGUAGE_OF) == 88
    assert languages.supported_languages(spark).first().language == "batch"
    assert len(REGEX_LANGUAGES) == 25 and len(CATEGORIES) == 15


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a, **e: subprocess.run(["git", *a], cwd=root, check=True, capture_output=True, env={**os.environ, **e})
    run("init", "-q")
    steps = [
        ("2024-01-01T10:00:00Z", "ann", {"a.py": "one\n", "b.py": "b\n"}, "first | with bar"),
        ("2024-01-05T10:00:00Z", "bob", {"a.py": "one\ntwo\n", "d|e.py": "x\n"}, "second"),
        ("2024-01-09T10:00:00Z", "ann", {"a.py": "one\nTWO\n", "b.py": "b2\n"}, "third"),
    ]
    for date, author, files, message in steps:
        for name, content in files.items():
            (root / name).write_text(content)
        run("add", "-A")
        who = {"GIT_AUTHOR_NAME": author, "GIT_AUTHOR_EMAIL": f"{author}@x", "GIT_COMMITTER_NAME": author,
               "GIT_COMMITTER_EMAIL": f"{author}@x", "GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date}
        run("commit", "-qm", message, **who)
    run("mv", "b.py", "c.py")
    run("commit", "-qm", "rename", **{**who, "GIT_AUTHOR_DATE": "2024-01-10T10:00:00Z", "GIT_COMMITTER_DATE": "2024-01-10T10:00:00Z"})
    return str(root)


def test_git_log(spark, repo):
    log = gitlog.read_log(spark, repo).cache()
    rows = {(r.message, r.path): (r.change_type, r.insertions, r.deletions) for r in log.collect()}
    assert rows == {
        ("first | with bar", "a.py"): ("added", 1, 0), ("first | with bar", "b.py"): ("added", 1, 0),
        ("second", "a.py"): ("modified", 1, 0), ("second", "d|e.py"): ("added", 1, 0),
        ("third", "a.py"): ("modified", 1, 1), ("third", "b.py"): ("modified", 1, 1), ("rename", "c.py"): ("renamed", 0, 0)}
    assert gitlog.commits_of(log).count() == 4
    changes = gitlog.changes_of(log)
    own = history.commits_for(changes, "a.py")
    s = history.summary(own).first()
    assert (s.total_commits, s.unique_authors) == (3, 2)
    assert s.last_modified == datetime.datetime(2024, 1, 9, 10) and s.first_seen == datetime.datetime(2024, 1, 1, 10)
    assert [r.message for r in history.recent_commits(changes, "a.py", 2).collect()] == ["third", "second"]
    assert [(r.path, r.co_change_count) for r in history.co_changed(changes, "a.py").collect()] == [("b.py", 2), ("d|e.py", 1)]
    now = F.lit(datetime.datetime(2024, 1, 12, 10)).cast("timestamp")
    assert tuple(history.change_frequency(own, now).first()) == (1, 3, 3)
    recent = history.recent_changes(changes, now, 10).collect()
    assert [(r.path, r.commits, r.message) for r in recent] == [
        ("a.py", 2, "third"), ("a.py", 2, "second"), ("b.py", 1, "third"), ("c.py", 1, "rename"), ("d|e.py", 1, "second")]


def test_git_blame(spark, repo, tmp_path):
    rows = gitlog.read_blame(spark, repo, "a.py", 1, 2).collect()
    assert [(r.line, r.author, r.email, r.message, r.content) for r in rows] == [
        (1, "ann", "ann@x", "first | with bar", "one"), (2, "ann", "ann@x", "third", "TWO")]
    assert gitlog.last_commit_for_line(spark, repo, "a.py", 2).first().message == "third"
    assert gitlog.read_log(spark, str(tmp_path)).count() == 0


def test_unreadable_files_are_reported_and_missing_roots_stop(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "good.py").write_text("x = 1\n")
    reader = filetree.FileTreeReader({"path": str(root)})
    rows = list(reader.read(filetree.FileChunk(["good.py", "gone.py"])))
    assert [(r[1], r[4], r[5] is None) for r in rows] == [("good.py", b"x = 1\n", True), ("gone.py", None, False)]
    reader.root = str(tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):
        list(reader.read(filetree.FileChunk(["good.py"])))


def test_missing_repository_in_a_task_stops(repo, tmp_path):
    reader = gitlog.GitLogReader({"path": repo})
    parts = reader.partitions()
    assert len(list(reader.read(parts[0]))) > 0
    reader.root = str(tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert list(reader.read(reader.partitions()[0])) == []
