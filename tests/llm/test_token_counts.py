import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece

from lodebook.llm import arrays, token_counts
from lodebook.llm.queries import op8_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op8_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(library.encode(texts[r.doc_id]))
        assert r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 4096)


def test_hard_texts(library):
    rng = random.Random(4)
    texts = ["", " ", "  ", "a" * 3000, "ab" * 900, " " * 5000 + "word" + " " * 70, "</s><s><unk> x", "\x00\t\n\r", "漢字かな" * 200,
             "▁▁x ▁", "a▁b", "= = = == ====" * 50, "\U0001F600" * 30]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 1500)))
              for alphabet in ("ab", "abc ", "aàe \n", "the in ", "01 ", " =-") for _ in range(12)]
    model = token_counts.load(MODEL)
    wide = pc.replace_substring(pa.array(texts), token_counts.BLANK, " ")
    wide = pc.if_else(pc.equal(pc.binary_length(wide), 0), "", pc.binary_join_element_wise(pa.scalar(" "), wide, pa.scalar("")))
    known: dict[int, int] = {}
    got = np.concatenate([token_counts.count_block(model, known, d, o) for _, _, d, o in arrays.blocks(wide, 5000)])
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_words_made_to_collide(library):
    # Thue-Morse words and their mirrors: equal under any sum of powers modulo 2**64.
    marks = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    texts = [marks, marks.translate(str.maketrans("ab", "ba"))] * 2
    wide = pa.array([" " + t for t in texts])
    got = [token_counts.count_block(token_counts.load(MODEL), {}, d, o) for _, _, d, o in arrays.blocks(wide)]
    counts = [len(x) for x in library.encode(texts)]
    assert np.concatenate(got).tolist() == counts and counts[0] != counts[1]


def test_awkward_rows(awkward, nothing, library):
    rows = token_counts.token_counts(awkward, MODEL).collect()
    assert len(rows) == 10
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert [r.over_limit for r in rows if r.doc_id == 4] == [True]
    assert token_counts.token_counts(nothing, MODEL).count() == 0
