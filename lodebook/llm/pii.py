"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only. A match's place follows from the lengths of the pieces between the matches, so
it is counted in code points, from 0, end exclusive. Card numbers must pass Luhn, account numbers modulo 97,
parts of addresses and numbers of digits their limits; a match that fails is dropped and not tried again.
The words just before and after a span raise or lower its score. Spans of the four base kinds always stay;
account numbers (iban) and identity numbers (ssn) stay from a score of `KEEP`.

Null and empty texts have no spans. Repeated rows are treated alike. `find_pii` adds a column `pii` and keeps
all others; an input column of that name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = 0.5
CONTEXT_CHARS = 32
BLOCK = 128  # matches whose places are added up together; sums of blocks are added next
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# A run that cannot start a match is entered only once: by look-behind, and at the end of the match before (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # All digits of a number belong to one match, so only numbers of 16 to 19 digits need to be looked at.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
#: What a text must hold before its pattern is run at all.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}
CONFIRMED = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
NEAR_WORDS = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "ip|host|server|login|client|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|identity|insurance",
}
DOUBT_WORDS = "example|sample|version|invoice|order|isbn|serial"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    def part(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    parts = F.transform(F.split(F.reverse(_digits(text)), ""), part)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(text: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        value(c) < 10, a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: F.when(
            F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return _mod97(value)
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(after, F.lit(CONTEXT_CHARS))))
    word = lambda options: F.when(near.rlike(f"(^|[^a-z])({options})"), 1).otherwise(0)
    return F.round(F.lit(CONFIRMED[kind]) + 0.2 * word(NEAR_WORDS[kind]) - 0.3 * word(DOUBT_WORDS), 2)


def _at(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _starts(blocks: Column) -> Column:
    """Characters before each block."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(blocks, none, lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])


def find_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with `pii`: an array of (kind, start, end, value, score) by kind as listed, then by start."""
    text = F.col(text_column).cast("string")
    found = docs.drop("pii").withColumns({
        f"_{k}_values": F.when(HINTS[k](text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS})
    found = found.withColumns({
        f"_{k}_pieces": F.when(F.size(f"_{k}_values") > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})

    def spans(kind: str) -> Column:
        values, pieces = F.col(f"_{kind}_values"), F.col(f"_{kind}_pieces")
        n = F.size(values)
        rows = F.arrays_zip(F.slice(pieces, 1, n).alias("before"), values.alias("value"),
                            F.slice(pieces, F.lit(2), n).alias("after"))
        kind_of = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
        none = F.array().cast(kind_of)

        def step(acc: Column, row: Column) -> Column:
            start = acc["at"] + F.length(row["before"])
            end = start + F.length(row["value"])
            score = _score(kind, row["before"], row["after"])
            good = _valid(kind, row["value"])
            if kind not in BASE_KINDS:
                good = good & (score >= KEEP)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"),
                            row["value"].alias("value"), score.alias("score"))
            return F.struct(end.alias("at"), F.when(good, F.array_append(acc["spans"], span))
                            .otherwise(acc["spans"]).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

        def in_blocks(rows: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(BLOCK)), lambda i: F.aggregate(
                F.slice(rows, i + 1, F.lit(BLOCK)), start, step))
            return _at(blocks, lambda b: F.flatten(F.zip_with(b, _starts(b), lambda block, at: F.transform(
                block["spans"], lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at)))))

        return (F.when(n > BLOCK, _at(rows, in_blocks))
                .when(n > 0, F.aggregate(rows, start, step, lambda acc: acc["spans"])).otherwise(none))

    found = found.withColumns({f"_{k}_spans": spans(k) for k in KINDS})
    return (found.withColumn("pii", F.concat(*[F.col(f"_{k}_spans") for k in KINDS]))
            .drop(*[f"_{k}_{x}" for k in KINDS for x in ("values", "pieces", "spans")]))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each row of docs (doc_id, text)."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"))


def _sql() -> str:
    """The same in DuckDB SQL, from the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT "
            "WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0")
    turned = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
    letter = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR "
              "coalesce(try_cast('0' || ltrim(p, '0') AS BIGINT), 256) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {letter})), "
                "lambda a, x: CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END % 97) = 1",
        "ssn": "true",
    }
    parts = []
    for k in KINDS:
        near = (f"lower(right(string_split_regex(text, '{plain[k]}')[i], {CONTEXT_CHARS}) || ' ' || "
                f"left(string_split_regex(text, '{plain[k]}')[i + 1], {CONTEXT_CHARS}))")
        score = (f"round({CONFIRMED[k]} + 0.2 * regexp_matches({near}, '(^|[^a-z])({NEAR_WORDS[k]})')::INT "
                 f"- 0.3 * regexp_matches({near}, '(^|[^a-z])({DOUBT_WORDS})')::INT, 2)")
        keep = valid[k] + ("" if k in BASE_KINDS else f" AND {score} >= {KEEP}")
        parts.append(f"""
  SELECT doc_id, {KINDS.index(k)} AS k, '{k}' AS kind, s AS start, s + length(v) AS stop FROM (
    SELECT doc_id, text, i, values[i] AS v,
           (list_sum(list_transform(pieces[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(values[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT doc_id, text, pieces, values, unnest(range(1, len(values) + 1)) AS i FROM (
      SELECT doc_id, text, regexp_extract_all(text, '{plain[k]}') AS values,
             string_split_regex(text, '{plain[k]}') AS pieces FROM documents)))
  WHERE {keep}""")
    union = "\n  UNION ALL".join(parts)
    line = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH found AS ({union}),
per_doc AS (
  SELECT doc_id, {counts},
         string_agg({line}, ',' ORDER BY k, start) FILTER (WHERE k < {len(BASE_KINDS)}) AS base,
         string_agg({line}, ',' ORDER BY k, start) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""


SQL = _sql()
