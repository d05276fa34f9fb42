"""The BM25 score as a column expression. Lower (more negative) is better."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def inverse_frequency(total: Column, containing: Column) -> Column:
    raw = F.log((total - containing + 0.5) / (containing + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def score(counts: list[Column], containing: list[Column], length: Column,
          total: Column, total_length: Column) -> Column:
    mean = total_length / total
    damp = K1 * (1 - B + B * length / mean)
    parts = [
        inverse_frequency(total, n) * (f * (K1 + 1.0)) / (f + damp)
        for f, n in zip(counts, containing)
    ]
    return -reduce(lambda a, b: a + b, parts)
