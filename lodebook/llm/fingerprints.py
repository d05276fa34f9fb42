"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes proposes boundaries; they are normalised: below the usual size
a boundary must be rare, above it a more frequent one is taken, and a chunk has at least 16 and at
most 128 bytes. An insertion moves only the boundaries next to it, so the set of chunk digests,
each weighted by the length of its chunk, shows what part of a text another one contains.

A fingerprint is the sorted set of its chunks, ten hexadecimal digits each: eight of the digest and
two of the length less one. Null is an empty text; an empty text has an empty fingerprint. Equal
texts have equal fingerprints; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import ship_package

LEAST, USUAL, MOST = 16, 48, 128
RARE_BITS, FREQUENT_BITS = 6, 4
FLUSH_CHARS = 1 << 19
GEAR = (arrays.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gears of the 16 bytes up to it, each shifted by its distance."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += older
    return h


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts of a block."""
    h = gear_hash(data) if len(data) else np.zeros(0, np.uint16)
    frequent = (np.flatnonzero(h < 1 << (16 - FREQUENT_BITS)) + 1).tolist()
    rare = (np.flatnonzero(h < 1 << (16 - RARE_BITS)) + 1).tolist()
    frequent.append(len(data) + MOST)
    rare.append(len(data) + MOST)
    ends: list[int] = []
    starts: list[int] = []
    f = r = 0
    for at, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while at < stop:
            starts.append(at)
            r = bisect_left(rare, at + LEAST, r)
            cut = rare[r]
            if cut >= at + USUAL:
                f = bisect_left(frequent, at + USUAL, f)
                cut = min(frequent[f], at + MOST)
            at = min(cut, stop)
            ends.append(at)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def chunk_keys(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(row << 40 | digest << 8 | length - 1), sorted and distinct, and the fingerprint of each row."""
    parts, prints = [np.zeros(0, np.uint64)], []
    for first, _, data, offsets in arrays.blocks(texts):
        starts, ends = chunk_bounds(data, offsets)
        digest = arrays.segment_hashes(data, starts, ends) >> np.uint64(32)
        rows = arrays.rows_of(starts, offsets)
        key = (rows.astype(np.uint64) << np.uint64(40)) | (digest << np.uint64(8)) | (ends - starts - 1).astype(np.uint64)
        key = np.unique(key)
        codes = np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().hex()
        cuts = (np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(40)) * 10).tolist()
        prints += [codes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        parts.append(key + (np.uint64(first) << np.uint64(40)))
    return np.concatenate(parts), prints


def _weights(keys: np.ndarray, rows: int) -> np.ndarray:
    size = (keys & np.uint64(255)).astype(np.int64) + 1
    return np.bincount((keys >> np.uint64(40)).astype(np.int64), weights=size, minlength=rows)[:rows]


def _contained(own: np.ndarray, other: np.ndarray, rows: int) -> np.ndarray:
    """For each row the share of its chunks, by length, that the other set of the row holds; of two empty sets 1."""
    total, theirs = _weights(own, rows), _weights(other, rows)
    shared = _weights(np.intersect1d(own, other, assume_unique=True), rows)
    return np.where(total > 0, shared / np.maximum(total, 1), (theirs == 0).astype(float))


def containment(fingerprint: str, other: str) -> float:
    """The share of the first fingerprint's chunks, by length, that the second one holds."""
    own, there = ({f[i:i + 10] for i in range(0, len(f), 10)} for f in (fingerprint, other))
    if not own:
        return float(not there)
    size = lambda chunks: sum(int(c[8:], 16) + 1 for c in chunks)
    return size(own & there) / size(own)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: its id and its fingerprint; no shuffle."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [arrays.column(batch, "id"), pa.array(chunk_keys(arrays.column(batch, "text"))[1], pa.string())],
                [id_column, "fingerprint"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, fingerprint string")


def _measure(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    edited, digests = [], []
    for text, after in zip(texts, [*texts[1:], following], strict=True):
        quarter = len(text) // 4
        edited.append(text[:len(text) - quarter] + after[:quarter])
        digests.append(hashlib.sha256(edited[-1].encode()).hexdigest())
    own, prints = chunk_keys(pa.array([*texts, following], pa.large_string()))
    changed, changed_prints = chunk_keys(pa.array(edited, pa.large_string()))
    n, row = len(texts), np.uint64(1 << 40)
    after = own[own >= row] - row
    own = own[own < np.uint64(n) * row]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()),
         pa.array(prints[:n], pa.string()), pa.array(changed_prints, pa.string()),
         pa.array(_contained(own, changed, n)), pa.array(_contained(own, after, n))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and id; each part ends with a copy of the row that follows it."""
    ids: list = []
    texts: list[str] = []
    held, part, closed = 0, None, False
    for batch in batches:
        columns = [arrays.column(batch, c) for c in ("part", "tail", "doc_id", "text")]
        for p, tail, i, text in zip(*(c.to_pylist() for c in columns), strict=True):
            text = text or ""
            if p != part:
                part, closed = p, False
            if closed:
                continue
            if tail:
                yield _measure(ids, texts, text)
                ids, texts, held, closed = [], [], 0, True
                continue
            if held > FLUSH_CHARS or len(texts) >= arrays.BLOCK_ROWS:
                yield _measure(ids, texts, text)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text)


def neighbour_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document.

    docs has doc_id (whole numbers) and text. The edited text has its last quarter replaced by the
    beginning of the next document in ascending doc_id; the first follows the last. Rows with the
    same id are ordered by text, rows without an id come last.

    The texts are shuffled once, by ranges of ids; only the ranges' first ids reach the driver.
    A copy of the row that begins the next range closes each range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("key"))
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0] if shares else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    placed = rows.withColumn("part", range_of("key"))
    first = {r["part"]: r["key"] for r in placed.groupBy("part").agg(F.min("key").alias("key")).collect()}
    order = sorted(first)
    if not order:
        order, first = [0], {0: 0}
    before = {first[p]: order[k - 1] for k, p in enumerate(order)}
    closing = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    tails = (rows.where(F.col("key").isin(list(before)))
             .select("doc_id", "text", "key", closing[F.col("key")].alias("part"), F.lit(1).alias("tail")))
    dealt = placed.withColumn("tail", F.lit(0)).unionByName(tails).repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", "tail", "key", "text").mapInArrow(
        _in_order, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                   "near_edited double, near_next double")
