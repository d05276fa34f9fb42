import random
from collections import defaultdict

import pyarrow as pa
import pytest

from lodebook.llm import arrays, ngram_join
from lodebook.llm.components import components
from lodebook.llm.queries import op2_ngram_jaccard_join


def shingles(texts: list[str]) -> list[frozenset]:
    out = []
    for _, _, data, offsets in arrays.blocks(arrays.lowered(pa.array(texts))):
        keys, cuts = arrays.shingle_sets(data, offsets, 5)
        out += [frozenset(keys[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def by_brute_force(docs: list[tuple[int, str]]) -> dict[int, tuple[int, int, int]]:
    """class_id, set_id and n_links of each document."""
    docs = sorted(docs)
    sets = dict(zip((i for i, _ in docs), shingles([t for _, t in docs]), strict=True))
    rep: dict[frozenset, int] = {}
    for i, _ in docs:
        rep.setdefault(sets[i], i)
    links, root = defaultdict(set), {i: i for i in rep.values()}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    items = [(i, s) for s, i in rep.items() if s]
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                links[i].add(j)
                links[j].add(i)
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(rep[sets[i]]), rep[sets[i]], len(links[rep[sets[i]]])) for i, _ in docs}


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def changed(rng: random.Random, text: list[str], edits: int) -> list[str]:
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = words(rng, 1)[0]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = [" ".join(words(rng, rng.randrange(3, 120))) for _ in range(300)]
    shared = words(rng, 40)
    docs += [" ".join(shared + words(rng, 60)) for _ in range(400)]  # a passage in many documents
    base = words(rng, 150)
    docs += [" ".join(changed(rng, base, rng.randrange(4))) for _ in range(420)]  # a large group of near copies
    for _ in range(60):
        own = words(rng, 80)
        docs += [" ".join(changed(rng, own, k)) for k in range(4)]
    docs += ["", "one two", "One, two!", "???", "???", docs[0], docs[1].upper()]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


def test_against_brute_force(spark, corpus):
    expected = by_brute_force(corpus)
    rows = ngram_join.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)).collect()
    assert len(rows) == len(corpus)
    wrong = [r for r in rows if (r.class_id, r.set_id, r.n_links) != expected[r.doc_id]]
    assert not wrong
    assert max(r.n_links for r in rows) > ngram_join.LEAF  # the large group needs more than one block


def test_small_leaves_and_splits_find_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join.leaf_buckets, "__defaults__", (40, 64, 4))
    expected = by_brute_force(corpus)
    rows = ngram_join.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    pairs = sum(e[2] for e in expected.values())
    assert sum(r.n_links for r in rows) >= 0.999 * pairs
    assert sum(r.class_id != expected[r.doc_id][0] for r in rows) == 0


def test_query(spark):
    rows = op2_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = by_brute_force(docs)
    assert {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in rows} == expected


def test_awkward_rows(awkward, nothing):
    rows = ngram_join.near_duplicates(awkward).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].set_id == by_id[2].set_id == 1 and by_id[1].n_links == 0
    assert by_id[5].class_id == by_id[6].class_id == 5
    assert by_id[None].class_id is None
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(200, 400)] + [(1000, k) for k in range(1001, 1400)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
