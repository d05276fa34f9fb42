"""Phrase collocations by Toivonen's mining.

A sample proposes words and shorter phrases that look frequent. One pass over all documents then counts, exactly, the
proposed phrases and their negative border: the phrases that were not proposed although all their parts were. Every
word is counted, a phrase of k words where both of its parts of k - 1 words are proposed. A border phrase that turns out
frequent has longer phrases that nobody counted; those are counted by a further pass, until no border phrase fails.
The result does not depend on the sample.

The proposed phrases reach the tasks as bits of their hashes, at most `MOST_BITS` for each length. A bit that two phrases
share only has more phrases counted, never fewer. Frequent phrases are counted by their own text.

Texts are read as bytes in windows of `WINDOW` bytes, each with the last words of the one before, so that neither a long
text nor one without punctuation needs more memory. Null texts are empty, a null language is `und`; other columns are
left alone; rows that repeat count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import materialize, ship_package

WINDOW = 1 << 21
OUT_ROWS = 1 << 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
BITS_PER_PHRASE = 32
SAMPLE = 0.25  # share of the documents that proposes phrases
SLACK = 0.8  # a phrase is proposed from this share of the count that a just frequent one has in the sample
SALTS = 32
SEEDS = (11, 29)

# 0: part of a word, 1: blank, 2: ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a window: bytes, bounds, hashes, and whether the next word follows within the piece."""

    def __init__(self, data: np.ndarray):
        kind = KIND[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == 0
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        pieces = np.cumsum(kind == 2, dtype=np.int32)
        self.follows = pieces[self.starts[1:]] == pieces[self.ends[:-1] - 1]
        self.sizes = self.ends - self.starts
        # Words joined by one blank each, so that every phrase is one stretch of bytes.
        kept = inside[1:-1].astype(bool)
        kept[self.ends] = True
        self.data = data[kept]
        self.places = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.data[self.places + self.sizes] = 0x20

    def add_hashes(self, seeds: tuple[int, ...]) -> None:
        self.hashes = arrays.wide_hashes(self.data, self.places, self.places + self.sizes, seeds)

    def phrases(self, length: int, carried: int) -> np.ndarray:
        """First words of the phrases of this length whose last word is not one of the carried ones."""
        count = len(self.starts) - length + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        good = np.ones(count, bool)
        for k in range(length - 1):
            good &= self.follows[k:k + count]
        good[:max(0, carried - length + 1)] = False
        return np.flatnonzero(good)

    def texts(self, first: np.ndarray, length: int) -> pa.Array:
        low, high = self.places[first], self.places[first + length - 1] + self.sizes[first + length - 1]
        offsets = np.concatenate([[0], np.cumsum(high - low)])
        taken = np.repeat(low - offsets[:-1], high - low) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.large_string(), len(first), [
            None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[taken])]).cast(pa.string())


def _closed(texts: pa.Array) -> pa.Array:
    """Every text with a line end after it, so that no piece runs into the next text."""
    empty, end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    return pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), empty, end)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a window's size, so that copies of a batch stay small."""
    _, offsets = arrays.buffers(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + WINDOW, "right")) - 1)
        yield begin, end
        begin = end


def windows(data: np.ndarray, overlap: int, size: int = WINDOW) -> Iterator[tuple[int, Words, int]]:
    """(first byte, words, how many of them the window before had already); data ends with the end of a piece."""
    low, high, carried = 0, 0, 0
    while high < len(data):
        high = min(high + size, len(data))
        if high < len(data):
            cut = np.flatnonzero(KIND[data[low:high]])
            while not len(cut) or low + cut[-1] < high - size:  # a word longer than the window
                high = min(high + size, len(data))
                cut = np.flatnonzero(KIND[data[low:high]])
            high = low + int(cut[-1]) + 1
        words = Words(data[low:high])
        yield low, words, carried
        carried = min(overlap, len(words.starts))
        low = low + int(words.starts[-carried]) if carried else high


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bits) - 1)
    return bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1


Bits = dict[int, np.ndarray]


def _both(bits: Bits, length: int, parts: tuple) -> np.ndarray:
    return has_bit(bits[length - 1], parts[0]) & has_bit(bits[length - 1], parts[1])


def everything(length: int, keys: np.ndarray, parts: tuple) -> np.ndarray:
    return np.ones(len(keys), bool)


def proposed_and_border(proposed: Bits):
    """All words, and the longer phrases whose two parts are proposed."""
    def chosen(length: int, keys: np.ndarray, parts: tuple) -> np.ndarray:
        return everything(length, keys, parts) if length == 1 else _both(proposed, length, parts)

    return chosen


def frequent_and_expansion(frequent: Bits, now: Bits, before: Bits, again: bool):
    """Phrases that may be frequent, and those whose parts became proposed; `again`: the latter only."""
    def chosen(length: int, keys: np.ndarray, parts: tuple) -> np.ndarray:
        seen = has_bit(frequent[length], keys)
        if length == 1:
            return seen & (not again)
        new = _both(now, length, parts) & ~_both(before, length, parts)
        return new & ~seen if again else new | seen

    return chosen


def _distinct(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place and the count of each value, or pair of values."""
    order = np.argsort(a)
    new = np.ones(len(a), bool)
    x = a[order]
    new[1:] = x[1:] != x[:-1]
    if b is not None:
        y = b[order]
        new[1:] |= y[1:] != y[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(a)))


def _count(longest: int, chosen, as_text: bool, totals: bool = False):
    """The task: for each window the distinct chosen phrases with their counts, as texts or as hashes.

    totals: also the number of all words, as a phrase of no words.
    """
    def phrases_of(words: Words, lang: np.ndarray, marks: list[np.ndarray], carried: int) -> Iterator[tuple]:
        keys, place = None, None
        for length in range(1, longest + 1):
            first = words.phrases(length, 0)
            parts = (keys[place[first]], keys[place[first + 1]]) if length > 1 else ()
            keys = arrays.joined_hashes(words.hashes[0], first, length, marks[0][lang[first]])
            good = (first + length > carried) & chosen(length, keys, parts)
            place = np.zeros(len(words.starts), np.int64)
            place[first] = np.arange(len(first))
            first, own = first[good], keys[good]
            other = arrays.joined_hashes(words.hashes[1], first, length, marks[1][lang[first]]) if as_text else None
            at, counts = _distinct(own, other)
            yield length, first[at], own[at], counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = SEEDS if as_text else SEEDS[:1]
        for batch in batches:
            langs = arrays.column(batch, "lang").dictionary_encode()
            codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            spread, offsets = arrays.buffers(names)
            marks = arrays.wide_hashes(spread, offsets[:-1], offsets[1:], seeds)
            texts = arrays.column(batch, "text")
            for begin, end in _slices(texts):
                data, offsets = arrays.buffers(_closed(texts[begin:end]))
                data = LOWER[data]
                for low, words, carried in windows(data, longest - 1):
                    words.add_hashes(seeds)
                    lang = codes[begin + np.searchsorted(offsets, low + words.starts, "right") - 1]
                    for length, first, keys, counts in phrases_of(words, lang, marks, carried):
                        for k in range(0, len(first), OUT_ROWS):
                            some = slice(k, k + OUT_ROWS)
                            size = pa.array(np.full(len(first[some]), length, np.int32))
                            if as_text:
                                yield pa.RecordBatch.from_arrays(
                                    [names.take(pa.array(lang[first[some]])), size, words.texts(first[some], length),
                                     pa.array(counts[some])], ["lang", "words", "phrase", "f"])
                            else:
                                yield pa.RecordBatch.from_arrays(
                                    [size, pa.array(keys[some].view(np.int64)), pa.array(counts[some])], ["words", "key", "f"])
                    if totals:
                        total = np.bincount(lang[carried:], minlength=len(names))
                        seen = np.flatnonzero(total)
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(seen)), pa.array(np.zeros(len(seen), np.int32)),
                             pa.array([""] * len(seen), pa.string()), pa.array(total[seen])], ["lang", "words", "phrase", "f"])
            pa.default_memory_pool().release_unused()

    return run


def _by_text(texts: DataFrame, longest: int, chosen, totals: bool) -> DataFrame:
    """lang, words, phrase, f by one pass over the texts; words = 0 has the number of words of a language."""
    found = texts.mapInArrow(_count(longest, chosen, True, totals), "lang string, words int, phrase string, f long")
    return found.repartition("lang", "words", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _by_key(texts: DataFrame, longest: int, chosen) -> DataFrame:
    """words, key, f: the same by the phrases' hashes; two phrases with one hash count as one.

    A window's phrases are added up in its task, so that a phrase is one row per window, however common it is. Most are
    rare: a second map of them in the memory of the task would save little, so rows are dealt out by phrase at once.
    """
    found = texts.mapInArrow(_count(longest, chosen, False), "words int, key long, f long")
    return found.repartition("words", "key").groupBy("words", "key").agg(F.sum("f").alias("f"))


def _sample(texts: DataFrame, share: float) -> DataFrame:
    part = 1 << 20
    return texts.where(F.pmod(F.xxhash64("text", "lang", F.lit(7)), F.lit(part)) < F.lit(int(share * part)))


def _new_keys(counts: DataFrame, longest: int, least: int, before: dict[int, np.ndarray]) -> DataFrame:
    """words, key of the frequent phrases of up to longest - 1 words whose bit is not set: border phrases that failed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, phrase = (arrays.column(batch, c).cast(pa.large_string()) for c in ("lang", "phrase"))
            spread, offsets = arrays.buffers(lang)
            marks = arrays.wide_hashes(spread, offsets[:-1], offsets[1:], SEEDS[:1])[0]
            data, offsets = arrays.buffers(_closed(phrase))
            words = Words(data)
            words.add_hashes(SEEDS[:1])
            size = arrays.column(batch, "words").to_numpy()
            first = np.searchsorted(words.starts, offsets[:-1])
            for length in range(1, longest):
                rows = np.flatnonzero(size == length)
                keys = arrays.joined_hashes(words.hashes[0], first[rows], length, marks[rows])
                keys = keys[~has_bit(before[length], keys)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), length, np.int32)), pa.array(keys.view(np.int64))], ["words", "key"])

    frequent = counts.where((F.col("f") >= least) & F.col("words").between(1, longest - 1))
    return frequent.select("lang", "words", "phrase").mapInArrow(run, "words int, key long")


def _sizes(keys: DataFrame, longest: int) -> dict[int, int]:
    """Bits for the keys of each number of words."""
    found = {n: LEAST_BITS for n in range(1, longest + 1)}
    for r in keys.groupBy("words").count().collect():
        found[r.words] = min(MOST_BITS, max(LEAST_BITS, 1 << (r["count"] * BITS_PER_PHRASE).bit_length()))
    return found


def _bitmaps(keys: DataFrame, sizes: dict[int, int]) -> Bits:
    """The bits of the keys for each number of words; every task sets bits, only whole bitmaps reach the driver."""
    width = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("words"))
    placed = keys.withColumn("bit", F.col("key").bitwiseAND(width.cast("long") - 1))
    # Spark's bitmaps of 4,096 bytes: bits 1 to 32,768 are bucket 1.
    at = F.col("bit") + 1
    parts = placed.groupBy("words", F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    found = {n: np.zeros(size // 8, np.uint8) for n, size in sizes.items()}
    for r in parts:
        found[r.words][(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return found


def count_phrases(docs: DataFrame, longest: int = 3, least: int = 10, sample: float = SAMPLE,
                  text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, words, phrase, f: exactly every phrase of up to `longest` words that occurs at least `least` times.

    Rows with words = 0 have the number of all words of a language. The sample decides what is counted in which pass,
    never the result. The pass over the proposed phrases and their border counts hashes, which are small and at worst make
    a phrase look more frequent; the next one counts the texts of those that passed, with the first expansion. Passes run
    until no phrase is left that could have a frequent longer one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    enough = max(1, int(least * sample * SLACK))
    proposed = materialize(_by_key(_sample(texts, sample), longest - 1, everything).where(F.col("f") >= enough), "proposed")
    sizes = _sizes(proposed, longest - 1)
    before = _bitmaps(proposed, sizes)
    first = materialize(_by_key(texts, longest, proposed_and_border(before)).where(F.col("f") >= least), "keys")
    frequent = _bitmaps(first, _sizes(first, longest))
    more = _bitmaps(first.where(F.col("words") < longest), sizes)
    now = {n: before[n] | more[n] for n in before}
    counted, again = None, False
    while True:
        chosen = frequent_and_expansion(frequent, now, before, again)
        fresh = materialize(_by_text(texts, longest, chosen, not again).where(
            (F.col("f") >= least) | (F.col("words") == 0)), "phrases")
        counted = counted.unionByName(fresh) if again else fresh
        failed = materialize(_new_keys(fresh, longest, least, now), "failed")
        if failed.isEmpty():
            return counted
        more = _bitmaps(failed, sizes)
        before, now, again = now, {n: now[n] | more[n] for n in now}, True


def _cuts(counts: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, a, k, l, r: every candidate with the counts of its parts for each cut."""
    blank = " "
    pieces = F.split("phrase", blank)
    candidates = counts.where((F.col("words") >= 2) & (F.col("f") >= least))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "words", "phrase", F.col("f").alias("a"), "k",
        F.concat_ws(blank, F.slice(pieces, 1, F.col("k"))).alias("head"),
        F.concat_ws(blank, F.slice(pieces, F.col("k") + 1, F.col("words") - F.col("k"))).alias("tail"))
    parts = counts.where(F.col("words").between(1, longest - 1)).select("lang", "phrase", "f")
    return (cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))


def _score() -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers."""
    a, product = F.col("a").cast("decimal(19,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * a * a).cast("decimal(38,0)"), product)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000,
                 sample: float = SAMPLE, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The best phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, n that of all words. Of the cuts in two parts with the counts l and r the one with the lowest
    floor(1000000 a² / (l r)) counts, the first of equal ones. A phrase goes if a longer frequent phrase holds it and has
    at least `share` hundredths of its count. Order: score, count, phrase by its bytes. An empty table has no rows.
    """
    counts = count_phrases(docs, longest, least, sample, text_column, lang_column)
    scored = _cuts(counts, longest, least).withColumn("score", _score())
    best = scored.groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select(
        "lang", "words", "phrase", "cut.score", "cut.a", "cut.l", "cut.r")
    pieces = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.concat_ws(" ", F.slice(pieces, at, size)))))
    longer = counts.where((F.col("words") >= 3) & (F.col("f") >= least)).select("lang", "f", F.explode(inner).alias("phrase"))
    holders = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = best.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # In two levels, so that no task sees more than `top` rows of each of `SALTS` parts of a language.
    spread = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (
    SELECT lang, list_filter(string_split_regex(p, '[ 	]+'), lambda w: w <> '') AS w
    FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-
]')) AS p FROM piece)),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cut AS (
    SELECT lang, k, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS tail
    FROM f, (SELECT unnest([1, 2]) AS j) WHERE k >= 2 AND j < k),
scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, h.f AS l, t.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score, j
    FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (
    SELECT lang, part AS phrase, max(f) AS f FROM (
        SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                                array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM f WHERE k = 3)
    GROUP BY ALL),
kept AS (
    SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
    WHERE h.f IS NULL OR 100 * h.f < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN total USING (lang) WHERE rank <= 2000
"""
