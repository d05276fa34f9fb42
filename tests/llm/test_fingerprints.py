import hashlib
import random

import numpy as np
import pyarrow as pa

from lodebook.llm import fingerprints as fp
from lodebook.llm.queries import op9_document_fingerprints


def edited(text: str, following: str) -> str:
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def test_query_against_plain_loops(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    rows = {r.doc_id: r for r in op9_document_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)]
        other, r = edited(text, following[1]), rows[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == fp.chunk_keys(pa.array([text, other]))[1]
        assert abs(r.near_edited - fp.containment(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - fp.containment(r.fingerprint, rows[following[0]].fingerprint)) < 1e-12
    assert np.mean([r.near_edited for r in rows.values()]) > 0.65
    assert np.mean([r.near_next for r in rows.values()]) < 0.05


def test_any_number_of_ranges_gives_the_same(spark, awkward):
    one = sorted(map(str, fp.neighbour_likeness(awkward, 1).collect()))
    assert len(one) == 10
    for parts in (2, 5, 40):
        assert sorted(map(str, fp.neighbour_likeness(awkward, parts).collect())) == one


def test_order_of_awkward_rows(awkward):
    rows = fp.neighbour_likeness(awkward, 3).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_chars == by_id[2].n_chars == 0 and by_id[1].fingerprint == ""
    assert by_id[1].near_edited == 1.0  # both empty
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert sum(r.doc_id == 6 for r in rows) == 2
    # The row without an id is the last; the first one (null, so empty) follows it.
    text = "a row without any id at all"
    assert by_id[None].edited_sha256 == hashlib.sha256(edited(text, "").encode()).hexdigest()


def test_small_tables(spark, nothing):
    assert fp.neighbour_likeness(nothing, 4).count() == 0
    one = spark.createDataFrame([(7, "only one document here, followed by itself")], "doc_id long, text string")
    r = fp.neighbour_likeness(one, 4).first()
    assert r.near_next == 1.0


def test_shift_resistance():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(5000))
    a, b = fp.chunk_keys(pa.array([text, "inserted words " + text]))[1]
    assert fp.containment(a, b) > 0.9
    bounds = fp.chunk_bounds(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    sizes = bounds[1] - bounds[0]
    assert sizes.max() <= fp.MOST and sizes[:-1].min() >= fp.LEAST and sizes.sum() == len(text)


def test_public_fingerprints(awkward):
    assert fp.fingerprints(awkward).count() == 10
