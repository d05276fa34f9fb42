import random
import re
from collections import Counter

import numpy as np
import pytest

from lodebook.llm import phrases


def brute(rows, longest=3, least=10, share=50, top=2000):
    """lang: [(phrase, a, l, r, n, score)] by plain loops."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    found = {}
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in good.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= share * a for b in inside):
                rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        if rows:
            found[lang] = rows[:top]
    return found


def got(frame):
    found: dict = {}
    for r in sorted(frame.collect(), key=lambda r: (r.lang, r["rank"])):
        found.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r["rank"] == len(found[r.lang])
    return found


def corpus(seed, docs, vocabulary=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÄé€x Q-") for _ in range(rng.randint(1, 12))) for _ in range(vocabulary)]
    return [(rng.choice(["en", "en", "en", None, "und", "", "日本"]),
             "".join(rng.choice(words[:rng.choice([5, vocabulary])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!?"])
                     for _ in range(rng.randint(0, 60)))) for _ in range(docs)]


@pytest.mark.parametrize("sample", [0.0, 0.25, 1.0])
def test_any_sample_gives_what_plain_loops_give(spark, sample):
    rows = corpus(3, 400)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    expected = brute(rows)
    assert sum(map(len, expected.values())) > 60
    assert got(phrases.collocations(frame, sample=sample)) == expected


def test_other_lengths_and_limits(spark):
    rows = corpus(4, 150, 12)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    for longest, least, share, top in ((4, 6, 80, 2000), (2, 10, 50, 7), (5, 8, 30, 3)):
        assert got(phrases.collocations(frame, longest, least, share, top)) == brute(rows, longest, least, share, top)


def test_small_windows_split_nothing(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "bb", "c" * 300, "dd", "e"]) + rng.choice(["", "", "", ","]) for _ in range(3000)) + "\n"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = phrases.Words(data)
    for size in (1, 7, 100, 1000, 1 << 20):
        for length in (1, 2, 3):
            parts: Counter = Counter()
            for _, words, carried in phrases.windows(data, 2, size):
                parts.update(words.texts(words.phrases(length, carried), length).to_pylist())
            assert parts == Counter(whole.texts(whole.phrases(length, 0), length).to_pylist())


def test_awkward_rows(spark, awkward, nothing):
    assert phrases.collocations(nothing).count() == 0
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert got(phrases.collocations(awkward)) == brute(rows)
    assert got(phrases.collocations(awkward, least=2)) == brute(rows, least=2)
    # Repeated rows count, ties are broken by the phrase.
    assert got(phrases.collocations(awkward, least=2))["en"][0][1] >= 3
