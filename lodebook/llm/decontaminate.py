"""Benchmark decontamination: rare word n-grams seed, Smith-Waterman alignment decides.

All word trigrams of the test items are counted over all documents (by how many hold them). Trigrams that no
document holds can't be found and are left aside. Of the others in every stretch of four of an item, the two that fewest
documents hold are its seeds, and all that at most `RARE` documents hold, so every part of an item is
covered, in edited copies too, and what everybody writes is not. A document with two seeds of an item at nearly the
same offset (or one, if at most `RARE` documents hold it or the item has fewer than four seeds) is aligned with the item
around them, word by word, by Smith-Waterman: equal words count 2, other pairs and gaps -1. The score is the alignment's share of the score of a whole
copy, so that edited, paraphrased and partial copies are found too.

Items come in blocks of at most `BLOCK_WORDS` words, which bounds what a task holds; each block is held against all
documents, without a shuffle of texts. Null and empty texts match nothing, nor do items without words; an item of one
or two words is looked for as a whole. Repeated rows give repeated results, equal items one result each.
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

GRAM = 3
BLOCK_WORDS = 500_000
THRESHOLD = 0.4  # unrelated texts reach a quarter
MATCH, OTHER, GAP = 2, -1, -1
WINDOW, KEPT = 4, 2
RARE = 100  # documents; what a seed that counts alone can cost in alignments


@dataclass
class Items:
    """Test items as word hashes, their n-grams, and which of these are seeds."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # distinct, sorted
    item: np.ndarray  # of each occurrence of an n-gram
    place: np.ndarray
    gram: np.ndarray  # index into grams
    alone: np.ndarray | None = None  # of seeds: is one of it enough for an alignment

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        words, item, place, found = [], [], [], []
        for k, text in enumerate(texts):
            _, own = _text_words(pa.array([text or ""]))
            words.append(own)
            first, grams = _grams(np.zeros(len(own), np.int64), own)
            item.append(np.full(len(first), k))
            place.append(first)
            found.append(grams)
        every = np.concatenate([*found, np.zeros(0, np.uint64)])
        grams, index = np.unique(every, return_inverse=True)
        return cls(ids, words, grams, np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64),
                   np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64), index)

    def seeds(self, counts: np.ndarray) -> Items:
        """Of the occurrences that any document holds, the rare ones and the rarest of their stretch of the item."""
        df = counts[self.gram]
        stretch = self.place // WINDOW
        order = np.lexsort((self.place, df, stretch, self.item))
        order = order[df[order] > 0]
        key = self.item[order] * (1 << 32) + stretch[order]
        first = np.searchsorted(key, key)
        keep = order[(np.arange(len(order)) - first < KEPT) | (df[order] <= RARE)]
        grams, index = np.unique(self.grams[self.gram[keep]], return_inverse=True)
        return Items(self.ids, self.words, grams, self.item[keep], self.place[keep], index, df[keep] <= RARE)


def _text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.buffers(arrays.lowered(texts))
    rows, _, _, hashes = arrays.words(data, offsets)
    return rows, hashes


def _grams(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text or an item; an item shorter than n is one n-gram of its own length."""
    first, grams = arrays.ngrams(rows, hashes, GRAM)
    if not len(first) and len(rows) and rows[0] == rows[-1]:
        return arrays.ngrams(rows, hashes, len(rows))
    return first, grams


class Lookup:
    """Finds which of many hashes are among the given ones: a small table first, then the sorted list."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = np.uint64(max(16, min(24, int(len(grams) * 16).bit_length())))
        self.table = np.zeros(1 << int(self.bits), bool)
        self.table[self._slot(grams)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> (np.uint64(64) - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes, index of the gram)"""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[self._slot(hashes)])
        at = np.minimum(np.searchsorted(self.grams, hashes[maybe]), len(self.grams) - 1)
        good = self.grams[at] == hashes[maybe]
        return maybe[good], at[good]


def _occurrences(texts: pa.Array, lookup: Lookup, short: tuple[int, ...]):
    """Per block: rows and hashes of all words, and the places and grams that the lookup knows."""
    for start, last, data, offsets in arrays.blocks(arrays.lowered(texts)):
        rows, _, _, hashes = arrays.words(data, offsets)
        parts = [arrays.ngrams(rows, hashes, n) for n in (GRAM, *short)]
        first = np.concatenate([p[0] for p in parts])
        which, gram = lookup.find(np.concatenate([p[1] for p in parts]))
        yield start, last - start, rows, hashes, first[which], gram


def count_grams(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each n-gram of the items occurs."""
    grams, short = items.grams, _short(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(grams), np.zeros(len(grams), np.int64)
        for batch in batches:
            for _, _, rows, _, place, gram in _occurrences(batch.column(0), lookup, short):
                pairs = np.unique(rows[place] * len(grams) + gram)
                total += np.bincount(pairs % len(grams), minlength=len(grams)) if len(pairs) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(grams), np.int64)
    counts[counted["gram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return counts


def _short(items: Items) -> tuple[int, ...]:
    return tuple(sorted({len(w) for w in items.words if 0 < len(w) < GRAM}))


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of the item with each window (rows of equal length): score, start and end in the window.

    A cell holds its score in the upper half and where its alignment begins in the lower.
    """
    count, width = windows.shape
    unit = np.int64(1) << np.int64(32)
    fresh = np.broadcast_to(np.arange(1, width + 1, dtype=np.int64), (count, width))
    column = np.arange(width, dtype=np.int64) * -GAP * unit
    cells = fresh.copy()
    best, end = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for word in item:
        before = np.concatenate([np.zeros((count, 1), np.int64), cells[:, :-1]], axis=1)
        new = before + np.where(windows == word, MATCH, OTHER) * unit
        new = np.maximum(np.maximum(new, cells + GAP * unit), fresh)
        # A gap in the item costs the same at every step, so a running maximum finds the best one.
        new = np.maximum.accumulate(new + column, axis=1) - column
        cells = np.maximum(new, fresh)
        top = cells.argmax(1)
        value = cells[np.arange(count), top]
        better = (value >> 32) > (best >> 32)
        best[better], end[better] = value[better], top[better] + 1
    return best >> 32, best & (unit - 1), end


def matches(texts: pa.Array, items: Items, lookup: Lookup, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, word after the last) of the best alignment of each text and item from the threshold on."""
    by_gram = np.argsort(items.gram, kind="stable")
    starts = np.searchsorted(items.gram[by_gram], np.arange(len(items.grams) + 1))
    per_item = np.bincount(items.item, minlength=len(items.ids))
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for start, count, rows, hashes, place, gram in _occurrences(texts, lookup, _short(items)):
        if not len(place):
            continue
        n = starts[gram + 1] - starts[gram]
        hit = np.repeat(np.arange(len(place)), n)
        occurrence = by_gram[np.repeat(starts[gram], n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
        row, item = rows[place[hit]], items.item[occurrence]
        offset = place[hit] - items.place[occurrence]
        first_word = np.searchsorted(rows, np.arange(count + 1))
        order = np.lexsort((offset, item, row))
        row, item, offset, occurrence = row[order], item[order], offset[order], occurrence[order]
        lengths = np.array([len(w) for w in items.words])
        slack = np.maximum(4, lengths // 4)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (offset[1:] - offset[:-1] > slack[item[1:]])
        cuts = np.append(np.flatnonzero(new), len(row))
        jobs: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k, r = int(item[a]), int(row[a])
            own = occurrence[a:b]
            if per_item[k] >= 2 * KEPT and not items.alone[own].any() and len(np.unique(own)) < 2:
                continue
            low = max(int(first_word[r]), int(offset[a]) - int(slack[k]))
            high = min(int(first_word[r + 1]), int(offset[b - 1]) + int(lengths[k] + slack[k]))
            jobs.setdefault(k, []).append((r, low, high))
        for k, windows in jobs.items():
            for at in range(0, len(windows), 64):
                part = windows[at:at + 64]
                width = max(high - low for _, low, high in part)
                grid = np.zeros((len(part), width), np.uint64)
                for j, (_, low, high) in enumerate(part):
                    grid[j, :high - low] = hashes[low:high]
                score, begin, end = align(items.words[k], grid)
                share = score / (MATCH * max(1, lengths[k]))
                for j, (r, low, _) in enumerate(part):
                    if share[j] >= threshold:
                        key = (start + r, k)
                        got = (float(share[j]), int(low + begin[j] - first_word[r]), int(low + end[j] - first_word[r]))
                        if key not in found or got[0] > found[key][0]:
                            found[key] = got
    return [(r, k, *rest) for (r, k), rest in sorted(found.items())]


def item_blocks(benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of about `most_words` words; one block at a time is on the driver."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (4 * most_words)))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield Items.of([r["item_id"] for r in part], [r["text"] for r in part])


FOUND = "doc_id long, item_id long, score double, start_word int, end_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) for every document and test item that align well."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result: DataFrame | None = None
    for items in item_blocks(benchmark):
        seeds = items.seeds(count_grams(source.select("text"), items))

        def run(batches: Iterator[pa.RecordBatch], seeds: Items = seeds) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(seeds.grams)
            for batch in batches:
                ids = arrays.column(batch, "doc_id")
                hits = matches(arrays.column(batch, "text"), seeds, lookup, threshold)
                if hits:
                    rows, item, score, begin, end = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array([seeds.ids[k] for k in item], pa.int64()), pa.array(score, pa.float64()),
                         pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
                        ["doc_id", "item_id", "score", "start_word", "end_word"])

        part = source.mapInArrow(run, FOUND)
        result = part if result is None else result.unionByName(part)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that align with a test item; all columns stay, texts are not shuffled."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")
    for items in item_blocks(benchmark):
        seeds = items.seeds(count_grams(docs.select("text"), items))

        def run(batches: Iterator[pa.RecordBatch], seeds: Items = seeds) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(seeds.grams)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[h[0] for h in matches(batch.column(at), seeds, lookup, threshold)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
