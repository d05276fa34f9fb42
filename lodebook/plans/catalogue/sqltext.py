"""Pieces of SQL shared by the catalogue."""

from __future__ import annotations

from lodebook.functions.text import FOLD_FROM, FOLD_TO, TOKEN_PATTERN


def fold(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}'), '[\\x{{300}}-\\x{{331}}]', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '{TOKEN_PATTERN}')"


def occurrences(fields: list[str], phrase: list[str]) -> str:
    parts = []
    for f in fields:
        if len(phrase) == 1:
            parts.append(f"len(list_filter({f}, lambda x: x = '{phrase[0]}'))")
        else:
            same = " AND ".join(f"{f}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
            parts.append(f"len(list_filter(range(1, len({f}) - {len(phrase) - 2}), lambda i: {same}))")
    return "(" + " + ".join(parts) + ")"


DOCUMENTS = f"""
tok AS (
  SELECT doc_id AS file_id, source || '/' || doc_id AS relative_path, lang AS language, n_chars AS size, text AS content,
         {tokens("source || '/' || doc_id")} AS t1, {tokens("text")} AS t2, {tokens("lang")} AS t3
  FROM documents)"""


def bm25(source: str, fields: list[str], keep: str, phrases: list[list[str]], match: str) -> str:
    """CTEs up to `scored` (keep, score) for rows of `source` that match; f0, f1, ... are hits."""
    n = range(len(phrases))
    counts = ", ".join(f"{occurrences(fields, p)} AS f{i}" for i, p in enumerate(phrases))
    length = " + ".join(f"len({f})" for f in fields)
    seen = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in n)
    idf = [f"ln((n - n{i} + 0.5) / (n{i} + 0.5))" for i in n]
    terms = " + ".join(
        f"(CASE WHEN {idf[i]} > 0 THEN {idf[i]} ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgd))"
        for i in n)
    return f"""
per AS (SELECT {keep}, {length} AS d, {counts} FROM {source}),
corpus AS (SELECT count(*) AS n, sum(d) * 1.0 / count(*) AS avgd, {seen} FROM per),
scored AS (SELECT {keep}, -({terms}) AS score FROM per, corpus WHERE {match})"""
