import random

import numpy as np
import pytest

from lodebook.llm import decontaminate
from lodebook.llm.queries import op5_benchmark_decontamination


def smith_waterman(item: list[str], text: list[str]) -> int:
    best, row = 0, [0] * (len(text) + 1)
    for word in item:
        new = [0]
        for j, other in enumerate(text):
            new.append(max(0, row[j] + (2 if word == other else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, max(new)), new
    return best


def test_alignment_against_plain_loops():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64)
        windows = rng.integers(1, 6, (5, rng.integers(1, 20))).astype(np.uint64)
        score, begin, end = decontaminate.align(item, windows)
        for k in range(5):
            assert score[k] == smith_waterman(item.tolist(), windows[k].tolist())
            # The span that it gives aligns as well as the whole window.
            assert smith_waterman(item.tolist(), windows[k, begin[k]:end[k]].tolist()) == score[k]


def vocabulary(rng):
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)] + ["the", "of", "and"] * 400


@pytest.fixture(scope="module")
def case():
    """Items, and documents with whole, edited and partial copies, and without any."""
    rng = random.Random(8)
    pool = vocabulary(rng)
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(15, 60)))) for k in range(40)] + [(40, "Two words"), (41, None), (42, "")]
    docs, planted = [], {}
    for k in range(400):
        text = [rng.choice(pool) for _ in range(rng.randrange(0, 300))]
        if k < 200:
            item, body = items[k % 40]
            own = body.split()
            if k % 4 == 1:
                own = [w if rng.random() > 0.15 else rng.choice(pool) for w in own]
            elif k % 4 == 2:
                own = [x for w in own for x in ([w] if rng.random() > 0.12 else rng.choice(([], [w, rng.choice(pool)])))]
            elif k % 4 == 3:
                own = own[:max(12, 2 * len(own) // 3)]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + own + text[at:]
            planted[k] = item
        docs.append((k, " ".join(text).capitalize() + "."))
    return items, docs, planted


def test_finds_planted_copies_and_nothing_else(spark, case):
    items, docs, planted = case
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {d for d, _ in got} <= set(planted)
    assert len(got & set(planted.items())) >= 0.98 * len(planted)
    assert all((d, i) in got for d, i in planted.items() if d % 4 == 0)


def test_finds_items_whose_only_copy_is_edited(spark):
    rng = random.Random(5)
    items, docs, close = [], [], set()
    for k in range(300):
        item = [f"w{rng.randrange(10 ** 6)}" for _ in range((15, 20, 38)[k % 3])]
        edited = [w if rng.random() > (0.2, 0.25, 0.3)[k // 3 % 3] else f"x{rng.randrange(10 ** 6)}" for w in item]
        around = [f"y{rng.randrange(10 ** 6)}" for _ in range(60)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(around[:30] + edited + around[30:])))
        if smith_waterman(item, edited) >= 0.4 * 2 * len(item):
            close.add((k, k))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert len(close) > 250 and got <= close and len(got) >= 0.98 * len(close)
    assert decontaminate.drop_leaks(docs, items).count() == 300 - len(got)


def test_item_blocks_find_the_same(spark, case):
    items, docs, _ = case
    docs, items = (spark.createDataFrame(r, s) for r, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    one = sorted(map(str, decontaminate.find_leaks(docs, items).collect()))
    assert len(list(decontaminate.item_blocks(items, 300))) > 1
    keep = decontaminate.item_blocks.__defaults__
    decontaminate.item_blocks.__defaults__ = (300,)
    try:
        assert sorted(map(str, decontaminate.find_leaks(docs, items).collect())) == one
    finally:
        decontaminate.item_blocks.__defaults__ = keep


def test_query(spark):
    texts, items = ({r[0]: r.text for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect()} for t in ("documents", "benchmark"))
    rows = {(r.doc_id, r.item_id): r.score for r in op5_benchmark_decontamination(spark, "/root/testdata/sf0.01").collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if " ".join(x.split()) in " ".join(t.split())}
    assert whole and whole <= {k for k, s in rows.items() if s == 1.0}


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "over and over again"), (2, None), (3, ""), (4, "two"), (4, "any id")], "item_id long, text string")
    found = decontaminate.find_leaks(awkward, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("5", 1), ("6", 1), ("6", 1), ("None", 4)]
    assert decontaminate.find_leaks(nothing, items).count() == 0
    assert decontaminate.find_leaks(awkward, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == 6
