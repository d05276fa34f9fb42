"""Text expressions: folding, tokens, lines, LIKE, previews and token estimates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _single_mark_letters() -> tuple[str, str]:
    """Lower-case letters that decompose into a base letter and exactly one mark."""
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and letter == letter.lower():
            source.append(letter)
            target.append(parts[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _single_mark_letters()
COMBINING_MARKS = "[̀-̱]"
TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics. Plain ASCII text skips the slower branch."""
    lowered = F.lower(text)
    stripped = F.regexp_replace(
        F.translate(lowered, FOLD_FROM, FOLD_TO), COMBINING_MARKS, ""
    )
    return F.when(F.octet_length(text) == F.char_length(text), lowered).otherwise(stripped)


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def driver_tokens(term: str) -> list[str]:
    """The same tokens for a search term held on the driver."""
    folded = "".join(
        FOLD_TO[FOLD_FROM.index(c)] if c in FOLD_FROM else c for c in term.lower()
    )
    folded = re.sub(COMBINING_MARKS, "", folded)
    return re.findall(r"[^\W_]+", folded)


def phrase_count(token_array: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in the token array (overlaps counted)."""
    if len(phrase) == 1:
        return F.size(token_array) - F.size(F.array_remove(token_array, F.lit(phrase[0])))

    def starts_here(word: Column, i: Column) -> Column:
        here = word == phrase[0]
        for offset, later in enumerate(phrase[1:], start=1):
            here = here & (F.get(token_array, i + offset) == later)
        return here

    # Most documents lack one of the words and are not walked at all.
    present = F.array_contains(token_array, phrase[0])
    for word in phrase[1:]:
        present = present & F.array_contains(token_array, word)
    return F.when(present, F.size(F.filter(token_array, starts_here))).otherwise(0)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_numbers(text: Column, predicate: Callable[[Column], Column]) -> Column:
    """1-based numbers of the lines that satisfy the predicate, without a shuffle."""
    numbered = F.transform(
        lines(text), lambda line, i: F.when(predicate(line), i + 1)
    )
    return F.array_compact(numbered)


def like_ci(column: Column, term: str) -> Column:
    """LIKE '%term%', case-blind for ASCII only; % and _ in the term stay wildcards."""
    parts = []
    for char in term:
        if char == "%":
            parts.append(".*")
        elif char == "_":
            parts.append(".")
        else:
            parts.append("\\" + char if not char.isalnum() and ord(char) < 128 else char)
    return column.rlike("(?is)" + "".join(parts))


def preview(text: Column, count: int = 10) -> Column:
    return F.substring_index(text, "\n", count)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def human_bytes(size: Column) -> Column:
    """Base 1024, one decimal, no trailing zero: 0 B, 1.5 KB, 2 MB."""
    power = F.least(F.lit(3), F.floor(F.log(1024.0, F.greatest(size, F.lit(1)))))
    value = F.round(size / F.pow(F.lit(1024.0), power), 1)
    number = F.regexp_replace(F.format_number(value, 1), r"\.0$|,", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), (power + 1).cast("int"))
    return F.when(size == 0, F.lit("0 B")).otherwise(F.concat_ws(" ", number, unit))


def time_ago(moment: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(moment)
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)

    def phrase(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, phrase(minutes, "minute"))
        .when(hours < 24, phrase(hours, "hour"))
        .when(days < 30, phrase(days, "day"))
        .otherwise(F.date_format(moment, "M/d/yyyy"))
    )
