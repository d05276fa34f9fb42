import random
import re

import numpy as np
import pytest

from lodebook.llm import licenses as lic

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, templates=lic.TEMPLATES, contained=lic.CONTAINED):
    """(places, blocks) of a text: every phrase at every word, every template against every window."""
    words = re.findall(WORD, lowered(text))
    places = [(label, i) for i in range(len(words)) for phrase, label in lic.PHRASES
              if words[i:i + len(phrase.split())] == phrase.split()]
    blocks = set()
    for t, (label, wording) in enumerate(templates):
        own = re.findall(WORD, lowered(wording))
        if not own:
            continue
        step = lic.SMALLEST
        while step < len(own):
            step *= 2
        own = set(own)
        for low in range(0, len(words), step):
            window = words[low:low + 2 * step]
            common = len(own & set(window))
            if 100 * common >= contained * len(own):
                blocks.add((t, label, low, low + len(window) - 1, common / len(own)))
    return words, places, blocks


def compare(rows, texts, **options):
    assert len(rows) == len(texts)
    for r in rows:
        words, places, blocks = brute(texts[r.doc_id], **options)
        assert r.n_words == len(words)
        assert [(p.label, p.word) for p in r.places] == places
        found = [(b.template, b.label, b.first, b.last, b.containment) for b in r.blocks]
        assert len(found) == len(set(found)) and set(found) == blocks


def noisy(rng, wording, share):
    words = wording.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = rng.choice(["foo", "the", "License", "version", "", "of"])
    return " ".join(words)


def texts_with_templates(seed, count):
    rng = random.Random(seed)
    filler = ["the", "of", "license", "under", "and", "any", "software", "été", "x1", "GNU", "public", "general"] + [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(count):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 70))))
            if rng.random() < 0.6:
                parts.append(noisy(rng, rng.choice(lic.TEMPLATES)[1], rng.choice([0, 0.05, 0.1, 0.2, 0.4])))
        texts[i] = rng.choice([" ", "\n", " // "]).join(parts)
    return texts


@pytest.mark.parametrize("contained", [100, 90, 60])
def test_join_equals_all_pairs(spark, contained):
    texts = texts_with_templates(contained, 120)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = lic.find_licenses(frame, contained=contained).collect()
    compare(rows, texts, contained=contained)
    assert sum(len(r.blocks) for r in rows) > 100


def test_own_templates(spark):
    rng = random.Random(8)
    letters = [chr(97 + i) for i in range(20)]
    templates = [(f"l{i % 7}", " ".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(30)]
    texts = {i: " ".join(rng.choice(letters[:rng.choice([4, 12, 20])]) for _ in range(rng.randint(0, 200))) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compare(lic.find_licenses(frame, templates=templates, contained=80).collect(), texts, templates=templates, contained=80)
    none = lic.find_licenses(frame, templates=[], phrases=[]).collect()
    assert all(r.places == [] and r.blocks == [] for r in none)


def test_filters_leave_few_pairs():
    known = lic.Templates()
    known.put_in_order({c: len(known.vocabulary) - c for c in range(len(known.vocabulary))})
    assert all((g.prefix.sum(axis=1) == g.sizes - g.needed + 1).all() for g in known.groups)
    assert len(np.unique(np.concatenate([g.templates for g in known.groups]))) == len(lic.TEMPLATES)


def test_awkward_rows(spark, awkward, nothing):
    assert lic.license_labels(nothing).count() == 0
    rows = lic.license_labels(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    empty = by_id[1]
    assert (empty.n_words, empty.n_base, empty.first_word, empty.last_word) == (0, 0, None, None)
    assert (empty.base_labels, empty.labels, empty.score) == ("", "", 0.0)
    assert by_id[4].n_words == 40000 and by_id[8].n_words == len(re.findall(WORD, "ünïcödé — ﬁ ａ é \U0001F600 \x00 ▁▁ </s>"))


def test_labels_and_scores(spark):
    long = "filler " * 30000
    texts = [(1, "X MIT-License, the mit\nLICENSE mit"), (2, "released under the MIT license." ), (3, long + lic.TEMPLATES[3][1] + " " + long),
             (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0."), (6, "general  public/license summit license")]
    rows = {r.doc_id: r for r in lic.license_labels(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].labels, rows[1].score) == (2, 1, 4, "mit", 1.0)
    assert (rows[2].base_labels, rows[2].labels) == ("mit", "mit")
    assert (rows[3].base_labels, rows[3].labels, rows[3].score) == ("", "bsd", 1.0)
    assert rows[4].labels == "cc-by,cc-by-nc" and rows[5].labels == "cc-by"
    assert (rows[6].n_base, rows[6].base_labels) == (1, "gpl")
