"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens that no vocabulary piece can cross: before a run of blanks, and
around bytes that occur in no piece. The distinct pre-tokens of a batch are held as one ragged
array of symbols. In each round every sequence applies its lowest-ranked pair, all sequences at
once, until no pair is left; the surviving symbols are counted, characters without a piece as
their UTF-8 bytes. Counts of pre-tokens are remembered per task in a table of bounded size.

Null and empty texts have no tokens. Repeated rows are counted as often as they occur; other
columns are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import ship_package

BLANK = "▁"
NONE = np.int64(1) << np.int64(40)
REMEMBERED = 400_000  # pre-tokens whose counts a task keeps
BLOCK = 1 << 20
LONG = 64  # symbols beyond which a sequence that needs single steps uses an agenda


class PieceMerges:
    """Pairs of pieces that may be merged, with their ranks, for a BPE model with byte fallback."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        usual = [i for i in range(size)
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in usual}
        scores = sorted({model.get_score(i) for i in usual}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.char = np.full(0x110000, -1, np.int32)
        pairs: dict[int, tuple[int, int]] = {}
        crossing = False
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            crossing |= BLANK in piece.lstrip(BLANK)
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = (rank[model.get_score(i)], i)
        # With a piece that crosses a blank a whole line is one pre-token.
        self.blank_cuts = not crossing
        self.char[ord(" ")] = self.char[ord(BLANK)]
        used = {c for piece in self.ids for c in piece}
        self.apart = np.array([b < 128 and b != 32 and chr(b) not in used for b in range(256)])
        self.size = size
        self._fill(np.array(list(pairs), np.int64), np.array([r for r, _ in pairs.values()], np.int64),
                   np.array([m for _, m in pairs.values()], np.int32))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Lay the pairs out in a sparse table with linear probing."""
        self.bits = max(8, int(len(keys) * 4).bit_length())
        slots = 1 << self.bits
        self.keys, self.ranks = np.full(slots, -1, np.int64), np.full(slots, NONE, np.int64)
        self.merged = np.zeros(slots, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            _, winners = np.unique(at[left], return_index=True)
            winners = left[winners]
            winners = winners[self.keys[at[winners]] < 0]
            self.keys[at[winners]], self.ranks[at[winners]] = keys[winners], ranks[winners]
            self.merged[at[winners]] = merged[winners]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it cannot be merged) and the piece that it makes."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -1  # an empty slot holds -1 and NONE
        at = self._slot(keys)
        there = self.keys[at]
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            there = self.keys[at[more]]
            more = more[(there != keys[more]) & (there >= 0)]
        rank = self.ranks[at]
        rank[keys < 0] = NONE
        return rank, self.merged[at]

    def one_by_one(self, symbols: list[int]) -> int:
        """Symbols left of one sequence, merged in order of rank and place; for long awkward ones."""
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(places: list[int]) -> None:
            places = [p for p in places if p >= 0 and after[p] >= 0]
            if places:
                ranks, made = self.find(np.array([symbols[p] for p in places]),
                                        np.array([symbols[after[p]] for p in places]))
                for p, r, m in zip(places, ranks.tolist(), made.tolist(), strict=True):
                    if r < NONE:
                        heapq.heappush(agenda, (r, p, symbols[p], symbols[after[p]], m))

        offer(list(range(len(symbols))))
        left = len(symbols)
        gone = -2
        while agenda:
            _, p, a, b, m = heapq.heappop(agenda)
            q = after[p]
            if symbols[p] != a or q < 0 or symbols[q] != b:
                continue
            symbols[p], symbols[q] = m, gone
            after[p] = after[q]
            if after[p] >= 0:
                before[after[p]] = p
            left -= 1
            offer([before[p], p])
        return left

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of the ragged sequences (none of them empty)."""
        result = lengths.astype(np.int64).copy()
        seq = np.repeat(np.arange(len(lengths)), lengths)
        sym = symbols.astype(np.int32)
        while len(seq) > 1:
            inside = seq[1:] == seq[:-1]
            rank, made = self.find(sym[:-1], sym[1:])
            rank = np.where(inside, rank, NONE)
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            lowest = np.minimum.reduceat(np.append(rank, NONE), starts)
            place = np.cumsum(np.concatenate([[0], ~inside]))  # sequence number among those left
            hit = (rank == lowest[place[:-1]]) & (rank < NONE)
            # Of overlapping hits every second one counts, from the left.
            at = np.arange(len(hit))
            run = at - np.maximum.accumulate(np.where(hit, -1, at))
            hit &= run % 2 == 1
            kept = np.ones(len(sym), bool)
            kept[1:][hit] = False
            new = sym.copy()
            new[:-1][hit] = made[hit]
            # A merge that makes a pair of no higher rank has to be the only one of its round.
            short, owner, fresh = new[kept], place[kept], np.append(hit, False)[kept]
            touched = fresh[:-1] | fresh[1:]
            same = owner[1:] == owner[:-1]
            check = np.flatnonzero(touched & same)
            again, _ = self.find(short[check], short[check + 1])
            early = np.unique(owner[check[again <= lowest[owner[check]]]])
            if len(early):
                bad = np.zeros(len(starts), bool)
                bad[early] = True
                many = np.bincount(place[:-1][hit], minlength=len(starts)) > 1
                bad &= many
                sizes = np.diff(np.append(starts, len(sym)))
                slow = np.flatnonzero(bad & (sizes > LONG))
                for s in slow:
                    own = sym[starts[s]:starts[s] + sizes[s]].tolist()
                    result[seq[starts[s]]] = self.one_by_one(own)
                gone = np.zeros(len(starts), bool)
                gone[slow] = True
                first = np.zeros(len(hit), bool)
                where = np.flatnonzero(hit)
                lead = where[np.concatenate([[True], place[where[1:]] != place[where[:-1]]])] if len(where) else where
                first[lead] = True
                hit &= ~bad[place[:-1]] | first
                kept = np.ones(len(sym), bool)
                kept[1:][hit] = False
                new = sym.copy()
                new[:-1][hit] = made[hit]
                kept &= ~gone[place]
                lowest[gone] = NONE
            # Sequences without a pair are done; the others go on with their shorter form.
            merges = np.bincount(place[:-1][hit], minlength=len(starts))
            going = lowest < NONE
            result[seq[starts[going]]] -= merges[going]
            kept &= going[place]
            sym, seq = new[kept], seq[kept]
        return result


@lru_cache(maxsize=4)
def load(model_file: str) -> PieceMerges:
    return PieceMerges(model_file)


SEEDS = (1,)


def _token_cuts(model: PieceMerges, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = model.apart[data]
    cut = apart.copy()
    cut[1:] |= apart[:-1]
    if model.blank_cuts:
        blank = data == 32
        cut[1:] |= blank[1:] & ~blank[:-1]
    inner = offsets[:-1]
    cut[inner[inner < len(data)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data))


def count_new(model: PieceMerges, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token counts of pre-tokens that have not been seen yet."""
    raw = b"".join(data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
    flat = np.frombuffer(raw, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    lead = (flat & 0xC0) != 0x80
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lengths = np.add.reduceat(lead.astype(np.int64), bounds[:-1])
    symbols = model.char[chars]
    counts = model.count(symbols, lengths)
    # A character without a piece is as many tokens as it has bytes.
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    extra = np.where(symbols < 0, width - 1, 0)
    return counts + np.add.reduceat(extra, np.concatenate([[0], np.cumsum(lengths)])[:-1])


def count_block(model: PieceMerges, known: dict[int, int], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a block; each text that is not empty begins with a blank of its own."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    starts, ends = _token_cuts(model, data, offsets)
    hashes, at, back = np.unique(arrays.wide_hashes(data, starts, ends, SEEDS)[0], return_index=True, return_inverse=True)
    counts = np.array([known.get(h, -1) for h in hashes.tolist()], np.int64)
    new = np.flatnonzero(counts < 0)
    if len(new):
        counts[new] = count_new(model, data, starts[at[new]], ends[at[new]])
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update(zip(hashes[new].tolist(), counts[new].tolist(), strict=True))
    rows = arrays.rows_of(starts, offsets)
    return np.bincount(rows, weights=counts[back], minlength=len(offsets) - 1).astype(np.int64)


def token_counts(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 4096) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(model_file), {}
        for batch in batches:
            texts = pc.fill_null(arrays.column(batch, "text"), "")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            texts = pc.replace_substring(texts, BLANK, " ")
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "",
                               pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))
            parts = [count_block(model, known, data, offsets) for _, _, data, offsets in arrays.blocks(texts, BLOCK)]
            n_tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [arrays.column(batch, "id"), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                [id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
