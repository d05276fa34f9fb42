"""License scans by an exact set-similarity join of text blocks and license templates.

A template is a set of words; a text block contains it if at least `CONTAINED` hundredths of these words are in the block.
Blocks are windows over the whole text: a template of at most s words (s a power of two, 8 at least) is compared with the
windows of 2 s words that begin at every multiple of s, so that every stretch of s words lies in one of them.

The join is exact and compares few pairs. Words are ordered by their frequency in all documents, rarest first. A pair that
needs c common words shares one of the template's first |T| - c + 1 words (prefix filter on both sides), the block has at
least c of the words that templates of its size use (length filter), and what follows the first common word on either side
must suffice for the rest (positional filter). Pairs that pass are counted in full.

Apart from that, a few fixed phrases count wherever their words stand one after the other. Null texts are empty; other
columns are left alone; every row has its own result. Templates are few: their words reach every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import ship_package

CONTAINED = 90
SMALLEST = 8
MOST_WORDS = 1_000_000  # words of all templates together
SEEDS = (3, 17)

# Phrases whose places count, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Wording of public licenses and of the usual notices that point to them.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
               "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
             "option) any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.array([b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])


def words_of(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return bytes(np.where(IN_WORD[data], data, 0x20).astype(np.uint8)).decode().split(" ") if text else []


@dataclass
class Group:
    """Templates that are compared with windows of one size, in terms of ranks: the words in global order."""

    step: int
    templates: np.ndarray  # their numbers
    sizes: np.ndarray  # distinct words
    needed: np.ndarray  # common words
    member: np.ndarray  # template x rank
    place: np.ndarray  # template x rank: how many words of the template come before this rank
    prefix: np.ndarray  # template x rank: a word of the template's prefix


class Templates:
    """All templates and phrases, with the global order of their words."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
                 contained: int = CONTAINED):
        self.labels = [label for label, _ in templates]
        self.lists = [[w for w in words_of(text) if w] for _, text in templates]
        self.phrases = [([w for w in words_of(text) if w], label) for text, label in phrases]
        self.contained = contained
        if sum(map(len, self.lists)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        self.vocabulary = sorted({w for ws in [*self.lists, *(p for p, _ in self.phrases)] for w in ws})
        self.code = {w: i for i, w in enumerate(self.vocabulary)}
        data = np.frombuffer("".join(self.vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.vocabulary]).astype(np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        first, self.second = arrays.wide_hashes(data, starts, ends, SEEDS)
        self.order = np.argsort(first)
        self.first = first[self.order]
        self.groups: list[Group] = []

    def codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, -1 for others."""
        found = np.full(len(starts), -1)
        if not len(starts) or not len(self.first):
            return found
        own = arrays.wide_hashes(data, starts, ends, SEEDS[:1])[0]
        at = np.minimum(np.searchsorted(self.first, own), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == own)
        if len(hit):
            code = self.order[at[hit]]
            same = arrays.wide_hashes(data, starts[hit], ends[hit], SEEDS[1:])[0] == self.second[code]
            found[hit[same]] = code[same]
        return found

    def put_in_order(self, frequency: dict[int, int]) -> None:
        """Form the groups once the frequencies of the words are known; ties go by the word."""
        ranking = sorted(range(len(self.vocabulary)), key=lambda c: (frequency.get(c, 0), c))
        self.rank = np.empty(len(ranking), np.int64)
        self.rank[ranking] = np.arange(len(ranking))
        steps: dict[int, list[int]] = {}
        for i, words in enumerate(self.lists):
            if words:
                steps.setdefault(max(SMALLEST, 1 << (len(words) - 1).bit_length()), []).append(i)
        for step, own in sorted(steps.items()):
            member = np.zeros((len(own), len(ranking)), bool)
            for k, i in enumerate(own):
                member[k, self.rank[[self.code[w] for w in self.lists[i]]]] = True
            sizes = member.sum(axis=1)
            needed = -(-self.contained * sizes // 100)
            place = np.cumsum(member, axis=1) - member
            self.groups.append(Group(step, np.array(own), sizes, needed, member, place,
                                     member & (place <= (sizes - needed)[:, None])))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges and which range each belongs to."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def matches(group: Group, ranks: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, template, window, common words) of all windows that contain a template.

    ranks: of every word, -1 for words of no template; row: of every word; bounds: first word of each row.
    """
    used, wanted = group.member.any(axis=0), group.prefix.any(axis=0)
    seeds = np.flatnonzero((ranks >= 0) & wanted[ranks])
    number = (seeds - bounds[row[seeds]]) // group.step
    most = int(number.max(initial=0)) + 2
    key = row[seeds] * most + number
    keys = np.unique(np.concatenate([key, key[number > 0] - 1]))
    owner, number = keys // most, keys % most
    low = bounds[owner] + number * group.step
    places, window = _ranges(low, np.minimum(low + 2 * group.step, bounds[owner + 1]) - low)
    there = ranks[places]
    good = (there >= 0) & used[there]
    size = len(used)
    own = np.unique(window[good] * size + there[good])  # each window's distinct words in global order
    window, rank = own // size, own % size
    first = np.searchsorted(window, np.arange(len(keys) + 1))
    held = np.diff(first)
    before = np.arange(len(own)) - first[window]
    pairs = []
    for t in range(len(group.templates)):
        needed = group.needed[t]
        # Length and prefix filters on both sides; the first common word of a window is its lowest rank.
        hit = np.flatnonzero(group.prefix[t][rank] & (held[window] >= needed) & (before <= held[window] - needed))
        blocks, at = np.unique(window[hit], return_index=True)
        hit = hit[at]
        rest = np.minimum(group.sizes[t] - group.place[t][rank[hit]], held[blocks] - before[hit])
        blocks = blocks[rest >= needed]  # positional filter
        words, which = _ranges(first[blocks], held[blocks])
        common = np.bincount(which, weights=group.member[t][rank[words]], minlength=len(blocks)).astype(np.int64)
        full = common >= needed
        pairs.append((owner[blocks[full]], np.full(full.sum(), group.templates[t]), number[blocks[full]], common[full]))
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True))


def _blocks(batch: pa.RecordBatch):
    for first, last, data, offsets in arrays.blocks(arrays.column(batch, "text")):
        data = LOWER[data]
        starts, ends = arrays.runs(IN_WORD[data], offsets)
        yield first, last, data, starts, ends, arrays.rows_of(starts, offsets)


def _frequencies(texts: DataFrame, templates: Templates) -> dict[int, int]:
    """How often each word of a template occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.vocabulary), np.int64)
        for batch in batches:
            for _, _, data, starts, ends, _ in _blocks(batch):
                codes = templates.codes(data, starts, ends)
                total += np.bincount(codes[codes >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    counted = texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code: r["n"] for r in counted.collect()}


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
                  contained: int = CONTAINED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, places and blocks.

    places: label and first word of every place of a phrase, by word. blocks: template (its number), label, first and last
    word, and containment (0 to 1) of every window that contains a template, overlapping ones included.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    known = Templates(templates, phrases, contained)
    known.put_in_order(_frequencies(texts.select("text"), known))

    def places(codes: np.ndarray, row: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        found, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (words, _) in enumerate(known.phrases):
            count = len(codes) - len(words) + 1
            if not words or count <= 0:
                continue
            good = row[:count] == row[len(words) - 1:]
            for i, w in enumerate(words):
                good &= codes[i:i + count] == known.code[w]
            found.append(np.flatnonzero(good))
            which.append(np.full(len(found[-1]), k))
        return found, which

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(known.labels, pa.string())
        phrase_labels = pa.array([label for _, label in known.phrases], pa.string())
        sizes = np.array([len(set(ws)) for ws in known.lists] or [0])
        for batch in batches:
            ids = arrays.column(batch, "id")
            for begin, end, data, starts, ends, row in _blocks(batch):
                rows = end - begin
                bounds = np.searchsorted(row, np.arange(rows + 1))
                codes = known.codes(data, starts, ends)
                at, which = (np.concatenate(c) for c in places(codes, row))
                order = np.lexsort((which, at))
                at, which = at[order], which[order]
                ranks = np.where(codes >= 0, known.rank[codes], -1) if len(known.rank) else codes
                parts = [matches(g, ranks, row, bounds) for g in known.groups]
                own, template, window, common = (np.concatenate([p[i] for p in parts]).astype(np.int64) if parts
                                                 else np.zeros(0, np.int64) for i in range(4))
                step = np.concatenate([np.full(len(p[0]), g.step) for p, g in zip(parts, known.groups, strict=True)] or [own])
                order = np.lexsort((template, window * step, own))
                own, template, window, common, step = (c[order] for c in (own, template, window, common, step))
                low = window * step
                high = np.minimum(low + 2 * step, np.diff(bounds)[own]) - 1
                place_list = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(
                        [phrase_labels.take(pa.array(which)), pa.array(at - bounds[row[at]])], ["label", "word"]))
                block_list = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(
                        [pa.array(template.astype(np.int32)), labels.take(pa.array(template)), pa.array(low), pa.array(high),
                         pa.array(common / sizes[template])], ["template", "label", "first", "last", "containment"]))
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:end], pa.array(np.diff(bounds).astype(np.int64)), place_list, block_list],
                    [id_column, "n_words", "places", "blocks"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        run, f"`{id_column}` {kind}, n_words long, places array<struct<label:string,word:long>>, "
             "blocks array<struct<template:int,label:string,first:long,last:long,containment:double>>")


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score: the greatest containment of a template, 1 where a phrase stands, else 0.
    """
    found = find_licenses(docs)

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    count = F.size("places").cast("long")
    return found.select(
        "doc_id", "n_words", count.alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "blocks.label")).alias("labels"),
        F.greatest(F.when(count > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"))


def _sql() -> str:
    """The same for DuckDB, with every window of every text against every template."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def lists(pairs) -> str:
        return ", ".join(f"({i}, {text(label)}, {text(words)})" for i, (label, words) in enumerate(pairs))

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH doc AS (
    SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({lower.format('text')}, '{word}') AS words FROM documents),
token AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM doc),
phrase(number, label, text) AS (VALUES {lists([(label, p) for p, label in PHRASES])}),
place AS (
    SELECT id, label, pos FROM (
        SELECT t.id, p.label, t.pos, p.text, d.words[t.pos + 1:t.pos + len(string_split(p.text, ' '))] AS found
        FROM token t JOIN phrase p ON t.word = string_split(p.text, ' ')[1] JOIN doc d ON d.id = t.id)
    WHERE array_to_string(found, ' ') = text),
template(number, label, text) AS (VALUES {lists(TEMPLATES)}),
split AS (SELECT number, label, regexp_extract_all({lower.format('text')}, '{word}') AS words FROM template),
sized AS (
    SELECT number, label, list_distinct(words) AS words, len(list_distinct(words)) AS size,
           greatest({SMALLEST}, 2 ** ceil(log2(len(words))))::BIGINT AS step
    FROM split),
need AS (SELECT *, (size * {CONTAINED} + 99) // 100 AS needed FROM sized),
part AS (SELECT number, unnest(words) AS word FROM need),
hit AS (SELECT t.id, n.number, t.word, t.pos // n.step AS win FROM token t JOIN part p USING (word) JOIN need n USING (number)),
win AS (
    SELECT id, number, win, count(DISTINCT word) AS common FROM (
        SELECT * FROM hit UNION ALL SELECT id, number, word, win - 1 FROM hit WHERE win > 0) GROUP BY ALL),
block AS (
    SELECT w.id, n.label, w.common::DOUBLE / n.size AS containment
    FROM win w JOIN need n USING (number) WHERE w.common >= n.needed),
base AS (
    SELECT id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY id),
labelled AS (
    SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
    FROM (SELECT id, label, 1.0::DOUBLE AS score FROM place UNION ALL SELECT id, label, containment FROM block) GROUP BY id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word, b.last_word,
       coalesce(b.base_labels, '') AS base_labels, coalesce(x.labels, '') AS labels, coalesce(x.score, 0.0)::DOUBLE AS score
FROM doc d LEFT JOIN base b USING (id) LEFT JOIN labelled x USING (id)
"""


SQL = _sql()
