"""The pipeline on planted documents, each stage against what it was given."""

import random

import pytest

import corpus_pipeline
from lodebook.llm import ngram_join
from lodebook.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(30)) for k in range(10)]
    docs, labels = {}, []
    for k in range(600):
        body = text(60)
        if k % 10 == 0:
            body += " vile nasty " + text(5)
        labels.append((k, k % 2, int(k % 10 == 0)))
        docs[k] = body
    docs[601] = docs[1]
    docs[602] = docs[2] + " more"
    docs[603] = text(20) + " " + items[3][1] + " " + text(20)
    docs[604] = text(30) + " token=0123abcd4567ef " + text(5)
    docs[605] = None
    docs[606] = ""
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in docs.items()]
    path = tmp_path_factory.mktemp("tables")
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert left == {r.doc_id for r in docs.collect()} - set(range(0, 600, 10))
    unique = steps["near_duplicates"](spark, clean, folder)
    kept = {r.doc_id for r in unique.collect()}
    assert left - kept == {601, 602, 606}
    groups = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(unique).collect()}
    assert all(d == c for d, c in groups.items())
    tested = steps["decontamination"](spark, unique, folder)
    assert kept - {r.doc_id for r in tested.collect()} == {603}
    safe = {r.doc_id: r for r in steps["secrets"](spark, tested, folder).collect()}
    before = {r.doc_id: r for r in tested.collect()}
    assert set(safe) == set(before)
    assert "[SECRET]" in safe[604].text and "0123abcd" not in safe[604].text and safe[604].n_chars == len(safe[604].text)
    assert all(safe[k] == before[k] for k in safe if k != 604)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {0, 10, 601, 602, 603, 605, 606}
    total = sum({r.source: r.source_size for r in rows}.values())
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * total, abs=10)


def test_repeated_rows_and_nulls(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", None, 11), (1, "a b c d e f", "x", None, 11), (None, "g h i j k l", "x", "s", 11),
                                  (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    numbers = {int(n.split("_")[0][2:]) for n in QUERIES}
    assert numbers == set(range(1, 11)) and set(QUERIES) <= set(entry.queries())
