"""Search terms: cleaning, and the flat AND / OR / NOT form of a full-text match."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column

from lodebook.functions.text import driver_tokens


def clean_term(term: str) -> str:
    """Keep letters, digits, blanks and underscores; everything else separates words.

    An empty result means the term has nothing to search for in the token index,
    and the caller falls back to LIKE.
    """
    return " ".join(re.sub(r"[^A-Za-z0-9\s_]", " ", term).split())


@dataclass(frozen=True)
class Match:
    """`groups` is an OR of ANDs; each AND item is a wanted phrase list and unwanted ones."""

    groups: tuple

    @property
    def phrases(self) -> list[tuple[str, ...]]:
        found = []
        for group in self.groups:
            for wanted, unwanted in group:
                found.extend(wanted)
                for block in unwanted:
                    found.extend(block)
        return found

    def words(self) -> list[str]:
        return sorted({word for phrase in self.phrases for word in phrase})

    @property
    def scored(self) -> list[int]:
        """Positions in `phrases` of those that count for the score."""
        wanted_at, position = [], 0
        for group in self.groups:
            for wanted, unwanted in group:
                wanted_at.extend(range(position, position + len(wanted)))
                position += len(wanted) + sum(len(block) for block in unwanted)
        return wanted_at

    def condition(self, counts: list[Column]) -> Column:
        """The match as a condition over one hit count per entry of `phrases`."""
        remaining = iter(counts)

        def all_of(block) -> Column:
            return reduce(lambda a, b: a & b, [next(remaining) > 0 for _ in block])

        def item(wanted, unwanted) -> Column:
            result = all_of(wanted)
            for block in unwanted:
                result = result & ~all_of(block)
            return result

        ands = [reduce(lambda a, b: a & b, [item(*part) for part in group]) for group in self.groups]
        return reduce(lambda a, b: a | b, ands)


def _split_on(words: list[str], keyword: str) -> list[list[str]]:
    blocks: list[list[str]] = [[]]
    for word in words:
        if word == keyword:
            blocks.append([])
        else:
            blocks[-1].append(word)
    if any(not block for block in blocks):
        raise ValueError(f"misplaced {keyword} in search term")
    return blocks


def match_of(term: str) -> Match | None:
    """The match for a raw term, or None when only LIKE can answer it.

    Blanks join words tightest, then NOT, AND and OR (upper case). A word that
    holds an underscore is a phrase of its parts.
    """
    words = [w for w in clean_term(term).split() if w.strip("_")]
    if not words:
        return None

    def phrases(block: list[str]) -> tuple:
        return tuple(tuple(driver_tokens(word)) for word in block)

    groups = []
    for any_block in _split_on(words, "OR"):
        group = []
        for all_block in _split_on(any_block, "AND"):
            wanted, *unwanted = _split_on(all_block, "NOT")
            group.append((phrases(wanted), tuple(phrases(block) for block in unwanted)))
        groups.append(tuple(group))
    return Match(tuple(groups))
