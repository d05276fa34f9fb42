from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodebook.llm import mixing
from lodebook.llm.queries import op1_mixing_sources


def targets(sizes: dict) -> dict:
    """Water filling by plain rounds."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        got = {s: 2.0 * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        more = {s for s in names if s not in full and got[s] > 2 * sizes[s]}
        if not more:
            return got
        full |= more


def check(rows) -> None:
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.0


def test_targets_and_taken(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    check(rows)
    again = {(r.doc_id, r.taken) for r in op1_mixing_sources(spark, folder).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_one_source_holds_most_rows(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", 1 + k % 50, (0.1, 1.0, 9.0, None)[k % 4]) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    few, many = (mixing.mix_sources(docs, bucket_rows=n).collect() for n in (100_000, 50))
    check(few)
    # The number of buckets does not change what is taken.
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_better_documents_come_first(spark):
    rows = [(k, "a", 10, 4.0 if k % 2 else 0.25) for k in range(2000)] + [(9999, "b", 60000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    mixed = mixing.mix_sources(docs, weights=(1, 6), share=(1, 1)).where("source = 'a'")
    got = {r["odd"]: r["t"] for r in mixed.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t")).collect()}
    assert got[1] > 2 * got[0]


def test_awkward_rows(awkward, nothing, no_labels):
    rows = mixing.mix_documents(awkward, no_labels).collect()
    assert len(rows) == 10
    check(rows)
    assert mixing.mix_documents(nothing, no_labels).count() == 0


def test_nothing_but_empty_texts(spark, no_labels):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert {(r.taken, r.target) for r in mixing.mix_documents(docs, no_labels).collect()} == {(0, 0.0)}


def test_no_python_in_the_plan(awkward, no_labels):
    plan = mixing.mix_documents(awkward, no_labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
