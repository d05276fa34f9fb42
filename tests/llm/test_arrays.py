import numpy as np
import pyarrow as pa

from lodebook.llm import arrays


def test_hash_does_not_depend_on_the_place(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 20_000).astype(np.uint8)
    data[rng.integers(0, 20_000, 4000)] = 32
    offsets = np.array([0, 5, 5, 9000, 20_000])
    rows, starts, ends, hashes = arrays.words(data, offsets)
    by_word: dict[bytes, int] = {}
    for s, e, h in zip(starts, ends, hashes.tolist(), strict=True):
        assert by_word.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(arrays, "SPAN_BYTES", 50)
    assert (arrays.words(data, offsets)[3] == hashes).all()
    assert set(rows.tolist()) <= {0, 2, 3}


def test_blocks_hold_whole_texts():
    texts = pa.array(["a b", None, "", "ü " * 500, "c"]).slice(1)
    parts = list(arrays.blocks(texts, 100))
    assert [(a, b) for a, b, _, _ in parts] == [(0, 2), (2, 3), (3, 4)]
    assert sum(len(d) for _, _, d, _ in parts) == 1501


def test_shingles_equal_plain_sets():
    texts = ["One two three four five six", "one, two three four five", "x", "x!", "", "???", "a a a a a a a a a"]
    found = []
    for _, _, data, offsets in arrays.blocks(arrays.lowered(pa.array(texts))):
        keys, cuts = arrays.shingle_sets(data, offsets, 5)
        found += [set(keys[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert [len(s) for s in found] == [2, 1, 1, 1, 0, 1, 1]
    assert found[1] < found[0] and found[2] == found[3]
