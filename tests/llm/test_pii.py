import hashlib
import re
import time

from pyspark.sql import functions as F

from lodebook.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[str]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c_d@e.f x..y@z.w", "a@b.co@d.ef g@h", "é a@ü.de b.c@d-e.f-g.h.", "1.2.3.4.5.6.7.8 999.1.1.1 00000255.1.01.1 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "x4111111111111111y 41111111111111111111", "4111  1111 1111 1111 1111111111111111",
    "+1 (555) 123-4567 +49 30 1234567890123456 +12 +1-2-3-4-5-6-7-8.", "++1 555 123 4567", "@@ a@b", "1" * 3000 + " 2.2.2.2",
    "IBAN DE89 3704 0044 0532 0130 00 account", "DE89370400440532013000", "DE89370400440532013001", "ssn 078-05-1120", "078-05-1120",
    "order sample 4111111111111111", "5500-0000-0000-0004 mail: me@x.org é 10.0.0.1 +4930123456", "", None, "a%b+c@d.e-f.gh.", "x@y.z" * 200,
]


def test_spans_of_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.pii_digests(docs).collect()}
    for k, text in enumerate(HARD):
        base = base_spans(text or "")
        own = [s for s in rows[k].spans.split(",") if s and s.split(":")[0] in BASE]
        assert own == base, text
        assert rows[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert rows[k].n_email == sum(s.startswith("email") for s in base)
    assert "iban:5:32" in rows[12].spans and rows[13].spans == "iban:0:22" and rows[14].spans == ""
    assert rows[15].spans == "ssn:4:15" and rows[16].spans == ""


def test_context_moves_the_score(spark):
    docs = spark.createDataFrame([(1, "credit card 4111111111111111"), (2, "4111111111111111"), (3, "order 4111111111111111")], "doc_id int, text string")
    scores = {r.doc_id: r.pii[0].score for r in pii.find_pii(docs).collect()}
    assert scores[1] > scores[2] > scores[3]


def test_planted_in_long_text(spark):
    text = "word " * 40000 + "me@example.org " + "é" * 1000 + " 5500000000000004"
    r = pii.pii_digests(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.spans.split(",") == base_spans(text)


def test_awkward_rows(awkward, nothing):
    rows = pii.pii_digests(awkward).collect()
    assert len(rows) == 10 and {r.spans for r in rows} == {""}
    assert pii.pii_digests(nothing).count() == 0
    found = pii.find_pii(awkward)
    assert found.columns == [c for c in awkward.columns if c != "pii"] + ["pii"]
    assert found.where(F.size("pii") > 0).count() == 0


def test_no_python_in_the_plan(awkward):
    plan = pii.pii_digests(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_matches_in_one_text(spark):
    texts = [" ".join(f"a{k}@b.org 10.0.{k % 300}.1 é" for k in range(n)) for n in (127, 128, 129, 1000, 32000)]
    started = time.time()
    rows = {r.doc_id: r for r in pii.pii_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert time.time() - started < 30
    for k, text in enumerate(texts):
        assert rows[k].spans == ",".join(base_spans(text))
