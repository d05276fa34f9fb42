"""Texts of an Arrow batch as numpy arrays: blocks, words, word n-grams and shingle sets.

Texts stay byte buffers, so a batch costs a few array passes and no Python object per word.
Every function looks at whole texts; a block only bounds how many texts are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
SPAN_BYTES = (1 << 20) + 1
BLOCK_ROWS = 4000  # a block's row number fits in the 12 bits that `shingle_sets` uses for it
_BASE = 0x9E3779B97F4A7C15
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)

#: Letters and digits; every byte of a character beyond ASCII counts as a letter.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least `size` of them."""
    return _powers(1 << max(18, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD[0]
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole texts, about `size` bytes unless one is longer."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + BLOCK_ROWS, len(texts))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each segment that does not depend on where it stands; segments are in order."""
    if len(data) <= SPAN_BYTES:
        return _hashes(data, starts, ends)
    found, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # a long text in spans, so that the powers stay few
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + SPAN_BYTES, "right")))
        found[first:last] = _hashes(data[low:ends[last - 1]], starts[first:last] - low, ends[first:last] - low)
        first = last
    return found


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run never crosses a text's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(mask)]] = False
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and hash of every word, in order."""
    starts, ends = runs(WORD_BYTE[data], offsets)
    return rows_of(starts, offsets), starts, ends, segment_hashes(data, starts, ends)


def ngrams(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n words that follow each other in a text."""
    if len(rows) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(rows[n - 1:] == rows[:len(rows) - n + 1])
    total = np.zeros(len(rows) - n + 1, np.uint64)
    for k in range(n):
        total += (hashes[k:len(rows) - n + 1 + k] ^ _ODD[(k + 3) % 8]) * _ODD[k % 8]
    return first, mix(total[first])


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text as sorted 52-bit values, and the bounds of each text's part.

    A text of fewer than n words is one shingle of all its words, one without words a shingle of
    its bytes; only an empty text has no shingle.
    """
    count = len(offsets) - 1
    rows, _, _, hashes = words(data, offsets)
    per_row = np.bincount(rows, minlength=count)
    first, grams = ngrams(rows, hashes, n)
    owner = rows[first]
    short = np.flatnonzero((per_row < n) & (np.diff(offsets) > 0))
    if len(short):
        ends = np.cumsum(per_row)
        more = np.empty(len(short), np.uint64)
        for k, row in enumerate(short):
            own = hashes[ends[row] - per_row[row]:ends[row]]
            if len(own):
                more[k] = (own * _ODD[:len(own)] + np.uint64(len(own))).sum(dtype=np.uint64)
            else:
                more[k] = segment_hashes(data[offsets[row]:offsets[row + 1]], np.array([0]),
                                         np.array([offsets[row + 1] - offsets[row]]))[0]
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, mix(more)])
    keys = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (grams >> np.uint64(12)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bounds = np.searchsorted(keys, np.arange(count + 1, dtype=np.uint64) << np.uint64(52))
    return keys & np.uint64((1 << 52) - 1), bounds


def _unaligned(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one value; bytes past the end are zero."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def wide_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed a hash of the bytes of each segment.

    Eight bytes at a time are mixed with their place in the segment before they are added, so that no arithmetic
    relation between places remains; two seeds give 128 bits.
    """
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in seeds]
    count = np.maximum((ends - starts + 7) >> 3, 1)
    first = np.cumsum(count) - count
    single = len(count) == count.sum()
    owner = slice(None) if single else np.repeat(np.arange(len(count)), count)
    step = np.zeros(len(count), np.int64) if single else np.arange(int(count.sum())) - first[owner]
    at = starts[owner] + (step << 3)
    left = np.clip(ends[owner] - at, 0, 8).astype(np.uint64)
    value = _unaligned(data)[at]
    value &= np.where(left < 8, (np.uint64(1) << ((left & np.uint64(7)) << np.uint64(3))) - np.uint64(1), ~np.uint64(0))
    found = []
    for seed in seeds:
        own = np.uint64(seed * _BASE % (1 << 64))
        keys = mix((np.arange(int(count.max()), dtype=np.uint64) + np.uint64(1)) * _ODD[2] + own)
        total = mix(value ^ keys[step])
        if not single:
            total = np.add.reduceat(total, first)
        found.append(mix(total + (ends - starts).astype(np.uint64) * _ODD[3] + own))
    return found


def joined_hashes(hashes: np.ndarray, first: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """A hash of the n segments from each first one on and of `more`, one value for each first one."""
    total = more * _ODD[4]
    for k in range(n):
        total += mix(hashes[first + k] + np.uint64((2 * k + 1) * _BASE % (1 << 64)))
    return mix(total)
