import random
import zlib

import pytest

from lodebook.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit_classifier(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = toxicity.score_texts(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)


def test_held_out_labels_teach_nothing(spark, fitted):
    docs, labels, model = fitted
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.fit_classifier(docs, other) == model


def sentences(rng, n):
    rows = []
    for k in range(n):
        words = [rng.choice("sun moon tree river stone cloud house road".split()) for _ in range(12)]
        toxic = k % 3 == 0
        if toxic:
            words[3] = rng.choice(["vile", "nasty"])
        if rng.random() < (0.7 if toxic else 0.1):
            words[7] = "muslim"  # a biased sample: the group is mostly named in toxic texts
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_swaps_reduce_bias(spark):
    rows = sentences(random.Random(1), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    fair = toxicity.fit_classifier(docs, labels, fairness=5.0)
    biased = toxicity.fit_classifier(docs, labels, fairness=0.0)
    neutral, swapped = "the muslim house by the river", "the hindu house by the river"
    gap = lambda m: abs(m.logit(neutral) - m.logit(swapped))
    assert gap(fair) < 0.5 * gap(biased)
    assert fair.score("a vile nasty road") > 0.3 > fair.score(neutral)


def test_swaps_of_sentences_reduce_bias_by_default(spark):
    rows = sentences(random.Random(1), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    fair, biased = toxicity.fit_classifier(docs, labels), toxicity.fit_classifier(docs, labels, fairness=0.0)
    neutral, swapped = "the muslim house by the river", "the hindu house by the river"
    gap = lambda m: abs(m.logit(neutral) - m.logit(swapped))
    print("GAPS", gap(fair), gap(biased), fair.score(neutral), biased.score(neutral))
    assert gap(fair) < 0.2 * gap(biased)
    assert fair.score("a vile nasty road") > 0.3 > fair.score(neutral)


def test_awkward_rows(spark, awkward, nothing, no_labels):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (9, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit_classifier(awkward, labels)
    rows = toxicity.score_texts(awkward, model).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].score == by_id[2].score and not by_id[None].held_out
    assert toxicity.score_texts(nothing, model).count() == 0
    unlabelled = toxicity.fit_classifier(awkward, no_labels)
    assert toxicity.drop_toxic(awkward, unlabelled).count() == 10
    assert toxicity.drop_toxic(awkward, unlabelled).columns == awkward.columns
