import json
import math
import re

import pytest
from pyspark.sql import functions as F

from lodebook import render
from lodebook.functions import paths, text
from lodebook.functions.jsonpatch import merge_patch
from lodebook.functions.match import clean_term, match_of
from lodebook.operators import postings, search
from lodebook.session import ship_package

DOCS = [
    (1, "src/a.ts", "the cat sat on the mat", "en"),
    (2, "src/b_test.ts", "The Cat_Sat there; élève Élève éte", "fr"),
    (3, "c.md", "dogs and cats. the the the", "en"),
    (4, "d.md", "", None),
    (5, "the/e.md", "cat sat cat sat cat", "de"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(DOCS, "file_id int, relative_path string, content string, language string").withColumn(
        "size", F.length("content").cast("long"))


def words(s):
    return text.driver_tokens(s or "")


def brute_bm25(phrases, match):
    """Scores of the fixture documents, computed without Spark."""
    rows = []
    for doc_id, path, content, lang in DOCS:
        fields = [words(path), words(content), words(lang)]
        hits = [sum(f[i:i + len(p)] == p for f in fields for i in range(len(f))) for p in phrases]
        rows.append((doc_id, sum(map(len, fields)), hits))
    n, avg = len(rows), sum(r[1] for r in rows) / len(rows)
    out = {}
    for doc_id, length, hits in rows:
        if not match(hits):
            continue
        score = 0.0
        for k in range(len(phrases)):
            seen = sum(1 for r in rows if r[2][k])
            idf = math.log((n - seen + 0.5) / (seen + 0.5))
            idf = idf if idf > 0 else 1e-6
            score -= idf * hits[k] * 2.2 / (hits[k] + 1.2 * (0.25 + 0.75 * length / avg))
        out[doc_id] = round(score, 9)
    return out


@pytest.mark.parametrize("term, phrases, match", [
    ("cat", [["cat"]], lambda h: h[0]),
    ("cat sat", [["cat"], ["sat"]], lambda h: h[0] and h[1]),
    ("cat_sat", [["cat", "sat"]], lambda h: h[0]),
    ("dogs OR mat", [["dogs"], ["mat"]], lambda h: h[0] or h[1]),
    ("eleve", [["eleve"]], lambda h: h[0]),
    ("ete", [["ete"]], lambda h: h[0]),
])
def test_scan_and_postings_agree_with_brute_force(files, term, phrases, match):
    expected = brute_bm25(phrases, match)
    scanned = {r.file_id: round(r.score, 9) for r in search.ranked_scan(files, term).collect()}
    assert scanned == expected
    corpus = files.agg(F.count("*"), F.sum(postings.document_length())).first()
    indexed = postings.ranked(postings.build(files), term, corpus[0], corpus[1], bucketed=False)
    assert {r.file_id: round(r.score, 9) for r in indexed.collect()} == expected


def test_not_and_precedence(files):
    found = lambda t: {r.file_id for r in search.ranked_scan(files, t).collect()}
    assert found("the NOT cat") == {3}
    assert found("the NOT cat sat") == {3}
    assert found("dogs OR cat AND mat") == {1, 3}
    assert found("the AND dogs NOT mat") == {3}


def test_language_filter_keeps_corpus_statistics(files):
    everything = {r.file_id: r.score for r in search.ranked_scan(files, "cat").collect()}
    german = {r.file_id: r.score for r in search.ranked_scan(files, "cat", languages=["de"]).collect()}
    assert german == {5: everything[5]}


def test_clean_term_and_router():
    assert clean_term("a.b-c!") == "a b c"
    assert match_of("***") is None and match_of("_") is None
    for broken in ("NOT a", "a OR", "AND", "a AND OR b"):
        with pytest.raises(ValueError):
            match_of(broken)


def test_like_is_blind_to_ascii_case_only(spark):
    df = spark.createDataFrame([("Ärger 100%",), ("ärger",), ("ARG_x",), ("a\nRG",)], "t string")
    hits = lambda term: {r.t for r in df.filter(text.like_ci(F.col("t"), term)).collect()}
    assert hits("Ä") == {"Ärger 100%"}
    assert hits("RG") == {"Ärger 100%", "ärger", "ARG_x", "a\nRG"}
    assert hits("A_G") == {"ARG_x"}
    assert hits("0%") == {"Ärger 100%"}
    assert hits("a%g") == {"ARG_x", "a\nRG"}


def test_lines_previews_tokens(spark):
    df = spark.createDataFrame([("a\nb foo\n\nfoo",)], "t string")
    row = df.select(
        text.line_numbers(F.col("t"), lambda l: l.contains("foo")).alias("n"),
        text.preview(F.col("t"), 2).alias("p"), text.estimate_tokens(F.col("t")).alias("e")).first()
    assert (row.n, row.p, row.e) == ([2, 4], "a\nb foo", 3)


def test_human_bytes_and_ages(spark):
    sizes = spark.createDataFrame([(0,), (500,), (1536,), (1048576,), (5 * 1024 ** 3,)], "n long")
    assert [r[0] for r in sizes.select(text.human_bytes(F.col("n"))).collect()] == ["0 B", "500 B", "1.5 KB", "1 MB", "5 GB"]
    ages = spark.sql("SELECT timestamp'2024-03-01 00:00:00' AS now, explode(array(30, 60, 7200, 86400 * 2, 86400 * 40)) AS s")
    got = ages.select(text.time_ago(F.col("now") - F.make_interval(secs=F.col("s").cast("decimal(18,6)")), F.col("now"))).collect()
    assert [r[0] for r in got] == ["just now", "1 minute ago", "2 hours ago", "2 days ago", "1/21/2024"]


def test_path_rules(spark):
    df = spark.createDataFrame([
        ("test/x.ts",), ("a/test/x.ts",), ("a.spec.js",), ("config/a.ts",), ("a.json",), ("a.tsx",), ("a.py",)], "p string")
    got = {r.p: (r.t, r.c) for r in df.select("p", paths.is_test(F.col("p")).alias("t"), paths.category(F.col("p")).alias("c")).collect()}
    assert got == {
        "test/x.ts": (False, "implementation"), "a/test/x.ts": (True, "tests"), "a.spec.js": (True, "tests"),
        "config/a.ts": (False, "configs"), "a.json": (False, "configs"), "a.tsx": (False, "other"), "a.py": (False, "implementation")}


def test_snippet_marks_first_hit(spark):
    long = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(long,)], "t string")
    shown = df.select(search.snippet(F.col("t"), ["w50"])).first()[0]
    assert shown.startswith("...w34 ") and "<mark>w50</mark>" in shown and shown.endswith("...")
    assert len(re.findall(r"w\d+", shown)) == 32


def test_json_in_pieces_equals_json_at_once():
    value = {"a": [1, {"b": "x\ny", "ü": None}], "empty": [], "none": {}, "d": {"e": [[], [2, "z"]], "f": True}, "g": 1.5}

    def streamed(v):
        if isinstance(v, dict):
            return {k: streamed(x) for k, x in v.items()}
        return (streamed(x) for x in v) if isinstance(v, list) else v

    pieces = list(render.json_text(streamed(value)))
    assert len(pieces) > 10
    assert "".join(pieces) == json.dumps(value, indent=2, ensure_ascii=False)
    assert "".join(render.json_text(value)) == "".join(pieces)


# The cases of RFC 7396, appendix A: target, patch, result.
MERGE_CASES = [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"),
    ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"c"}', '{"a":["b"]}', '{"a":["b"]}'),
    ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'),
    ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"a":"b"}', '["c"]', '["c"]'), ('{"a":"foo"}', "null", "null"), ('{"a":"foo"}', '"bar"', '"bar"'),
    ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
]


def test_merge_patch(spark):
    ship_package(spark)
    rows = [*MERGE_CASES, ('{"a":1}', None, '{"a":1}'), (None, '{"a":{"ü":null,"b":2}}', '{"a":{"b":2}}'), (None, None, None)]
    frame = spark.createDataFrame(rows, "target string, patch string, expected string").repartition(2)
    found = frame.select("expected", merge_patch(F.col("target"), F.col("patch")).alias("got")).collect()
    assert len(found) == len(rows) and all(r.got == r.expected for r in found)
