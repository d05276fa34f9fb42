"""Whitening of embeddings along the leading components of their covariance.

Each entry becomes the whole number floor(256 c). The covariance is that of the distinct vectors. Its sums of products are
exact: tasks multiply limbs of 20 bits, whose products fit in doubles without rounding, and Spark adds whole numbers; n,
sums and covariance reach the driver as one value per pair of dimensions, whatever the number of rows. There the centred
covariance is formed in whole numbers, rounded once, and `spectrum` finds the components.

Rows whose vector is null or has null or non-finite entries are dropped. Shorter vectors are filled with zeros up to the
longest one. Entries beyond the range of a long take its nearest value. A deviation beyond that range is null. A component
without variance (fewer distinct vectors than components) has whitened null; without any variance explained and
identity_error are null too. An empty table gives no rows; null ids stay; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.llm.spectrum import EPS, leading_pairs
from lodebook.session import materialize, ship_package

SCALE = 256
LIMB = 20
BLOCK = 1 << 12  # rows whose products of limbs add up below 2**53
FLUSH = 64  # blocks that are added in 64 bits before they are handed on
SAFE = 1 << 62


@dataclass
class Whitening:
    """The model: centre as sums over n, components as columns, what they explain, and how well it whitens."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S for each row: exact, as 64-bit values where they fit."""
        most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        if self.n * most + max(map(abs, self.sums), default=0) < SAFE:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Each row on each component over the root of its eigenvalue; not a number where that is zero."""
        centred = deviations.astype(float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred @ self.vectors / np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)


def whole_vectors(table: DataFrame, column: str, *carry: str) -> DataFrame:
    """The rows with a usable vector: carry and x, all of the same length."""
    good = table.where(F.col(column).isNotNull()).where(
        ~F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))
    vectors = good.select(*carry, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    shape = vectors.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if shape.least == shape.most:
        return vectors
    return vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(shape.most) - F.size("x"))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = arrays.column(batch, "x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of limbs times powers of 2**20; the last one carries the sign."""
    found = []
    while x.size and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        found.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*found, x.astype(float)]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, level, sums: rows of the product matrix of (x, 1) in powers of 2**20."""
    held: dict[int, np.ndarray] = {}
    blocks = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for level, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(np.full(len(sums), level, np.int32)),
                 pa.array(list(sums), pa.list_(pa.int64()))], ["row", "level", "sums"])
        held.clear()

    for batch in batches:
        x = _matrix(batch)
        for k in range(0, len(x), BLOCK):
            limbs = _limbs(x[k:k + BLOCK])
            wide = [np.column_stack([limb, np.full(len(limb), float(i == 0))]) for i, limb in enumerate(limbs)]
            for i, left in enumerate(wide):
                for j, right in enumerate(wide):
                    held[i + j] = held.get(i + j, 0) + (left.T @ right).astype(np.int64)
            blocks += 1
            if blocks % FLUSH == 0:
                yield from handed_on()
    yield from handed_on()


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """The model of a table of distinct x; None without rows."""
    sums = distinct.select("x").mapInArrow(_products, "row int, level int, sums array<long>")
    parts = (sums.select("row", "level", F.posexplode("sums").alias("other", "part"))
             .groupBy("row", "other", "level").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect())
    if not parts:
        return None
    size = max(r.row for r in parts)
    product = np.zeros((size + 1, size + 1), object)
    for r in parts:
        product[r.row, r.other] += int(r.total) << (LIMB * r.level)
    n, sums = int(product[size, size]), [int(s) for s in product[size, :size]]
    centred = n * product[:size, :size] - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()], float).reshape(size, size)
    values, vectors = leading_pairs(covariance, components)
    total = sum(int(centred[i, i]) for i in range(size)) / (n * n)
    values = np.where(values > size * EPS * values.max(initial=0), values, 0)
    return Whitening(n, sums, values, vectors, [float(v) / total if total else None for v in values])


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, measured on the table."""
    used = np.flatnonzero(model.values > 0)
    if not len(used):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.whitened(model.deviations(_matrix(batch)))[:, used]
            wide = np.column_stack([w, np.ones(len(w))])
            sums = wide.T @ wide
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], ["row", "sums"])

    parts = (distinct.select("x").mapInArrow(run, "row int, sums array<double>")
             .select("row", F.posexplode("sums").alias("other", "part"))
             .groupBy("row", "other").agg(F.sum("part").alias("total")).collect())
    total = np.zeros((len(used) + 1, len(used) + 1))
    for r in parts:
        total[r.row, r.other] = r.total
    mean = total[-1, :-1] / model.n
    return float(np.abs(total[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(used))).max())


def whiten(table: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per usable row and component: the id, component, n, deviation, whitened, explained, identity_error."""
    ship_package(table.sparkSession)
    schema = (f"`{id_column}` {table.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    vectors = whole_vectors(table, vector_column, id_column)
    distinct = materialize(vectors.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    model.identity_error = identity_error(distinct, model)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = model.deviations(_matrix(batch))
            most = int(np.abs(moved).max()) if moved.size else 0
            if most * most * max(1, moved.shape[1]) < SAFE:
                squares = (moved.astype(np.int64) ** 2).sum(axis=1, dtype=np.int64).tolist()
            else:
                squares = [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in moved)]
            w = model.whitened(moved).ravel()
            rows = len(moved)
            yield pa.RecordBatch.from_arrays(
                [arrays.column(batch, id_column).take(pa.array(np.repeat(np.arange(rows), count))),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(rows * count, model.n)),
                 pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(rows), count))),
                 pa.array(w, mask=np.isnan(w)), pa.array(model.explained * rows, pa.float64()),
                 pa.array([model.identity_error] * (rows * count), pa.float64())],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
