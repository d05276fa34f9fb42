"""The registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from lodebook.plans.catalogue import builds, code, graphs, histories, languages, texts

QUERIES = {**texts.QUERIES, **code.QUERIES, **graphs.QUERIES, **histories.QUERIES, **builds.QUERIES, **languages.QUERIES}


def callables() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def reference_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
