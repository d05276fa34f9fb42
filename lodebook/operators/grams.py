"""Which blocks of files may hold a substring: the three-byte sequences of their texts.

Files are grouped by the first digits of their hexadecimal ids, so that a block has about `BLOCK_BYTES` of text and lies
together in a table sorted by id. A text that holds a string holds all its three-byte sequences, in any case of the
letters A to Z; the blocks that have all of them are few for a rare name, and only their texts are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodebook.session import ship_package

BLOCK_BYTES = 1 << 20
SPAN = 1 << 22
BUCKET_BYTES = 1 << 30
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def digits_of(total_bytes: int) -> int:
    """Digits of the ids that tell the blocks apart, for so much text."""
    return max(0, math.ceil(math.log(max(1, total_bytes / BLOCK_BYTES), 16)))


def buckets_of(total_bytes: int) -> int:
    return max(1, math.isqrt(total_bytes // BLOCK_BYTES))


def block_of(file_id: Column, digits: int) -> Column:
    return F.substring(file_id, 1, digits) if digits else F.lit("")


def grams_of(term: str, wildcards: bool = False) -> list[int]:
    """The sequences that every text with this term has; none if it is too short, and then nothing is ruled out.

    With wildcards % and _ stand for anything and separate the pieces of the term.
    """
    found: set[int] = set()
    for piece in re.split("[%_]", term) if wildcards else [term]:
        data = LOWER[np.frombuffer(piece.encode(), np.uint8)].astype(int).tolist()
        found.update((a << 16) | (b << 8) | c for a, b, c in zip(data, data[1:], data[2:]))
    return sorted(found)


def build(files: DataFrame, digits: int) -> DataFrame:
    """gram, block: each pair once. Pairs are distinct per batch where the texts are read, then overall."""
    ship_package(files.sparkSession)
    source = files.select(block_of(F.col("file_id"), digits).alias("block"), F.coalesce("content", F.lit("")).alias("content"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).dictionary_encode()
            codes, names = blocks.indices.to_numpy(), blocks.dictionary
            seen: dict[int, list[np.ndarray]] = {}
            for code, text in zip(codes.tolist(), batch.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for low in range(0, max(0, len(data) - 2), SPAN):
                    part = LOWER[data[low:low + SPAN + 2]].astype(np.int32)
                    seen.setdefault(code, []).append(np.unique((part[:-2] << 16) | (part[1:-1] << 8) | part[2:]))
            for code, parts in seen.items():
                grams = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pc.take(names, pa.array(np.full(len(grams), code)))], ["gram", "block"])

    return source.mapInArrow(find, "gram int, block string").distinct()


def write(grams: DataFrame, path: str, total_bytes: int) -> None:
    """Partitioned by bucket of the sequence, sorted, so that a term reads a few stretches of a few files."""
    buckets = buckets_of(total_bytes)
    placed = grams.drop("bucket").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    (
        placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "block")
        .write.partitionBy("bucket").parquet(path)
    )


def bucket_filter(grams: list[int], total_bytes: int) -> Column:
    """The rows of these sequences; folded to literals before the scan, which reads their buckets only."""
    buckets = buckets_of(total_bytes)
    own = [F.pmod(F.xxhash64(F.lit(g)), F.lit(buckets)).cast("int") for g in grams]
    return F.col("gram").isin(grams) & F.col("bucket").isin(own)


def in_blocks(blocks: list[str]) -> Column:
    """The ids of some blocks as ranges, which a scan of a table sorted by id skips by."""
    condition = F.lit(False)
    for block in blocks:
        inside = F.col("file_id") >= block
        if block:
            inside = inside & (F.col("file_id") < block[:-1] + chr(ord(block[-1]) + 1))
        condition = condition | inside
    return condition
