import math
import random

import numpy as np
import pytest

from lodebook.llm import spectrum, whitening
from lodebook.llm.queries import op13_embedding_whitening


def random_matrix(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [3, 3, 3, 1, 0], [1e9, 1, 1e-3, 0], [2.0], [7, 7 - 1e-9, 7 - 2e-9, 1, 1], [0, -1, -5, -5], [1, 0, 0, 0, 0, 0]])
def test_leading_pairs(values):
    rng = np.random.default_rng(4)
    a = random_matrix(rng, np.array(values, float))
    a = (a + a.T) / 2
    found, vectors = spectrum.leading_pairs(a, 4)
    scale = max(map(abs, values))
    assert np.allclose(found, sorted(values, reverse=True)[:4], rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-12 * scale)


def test_counts_are_the_inertia():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 10, 40):
        a = rng.standard_normal((size, size))
        a = a + a.T
        if size > 2:
            a[np.diag_indices(size)] = 0  # needs 2 x 2 pivots
        own = np.linalg.eigvalsh(a)
        for shift in [*((own[1:] + own[:-1]) / 2), own[0] - 1, own[-1] + 1, 0.0]:
            assert spectrum.count_above(a, shift) == (own > shift).sum()
    assert spectrum.count_above(np.zeros((3, 3)), 0.0) == 0


def brute(rows, components=4):
    """Whole-number model of all rows by plain loops, and numpy's eigenvectors."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (size - len(v))) for i, v in good]
    fit = sorted({tuple(v) for _, v in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit]
    exact = [[sum(v[i] * v[j] for v in centred) / n ** 3 for j in range(size)] for i in range(size)]
    values, vectors = np.linalg.eigh(np.array(exact))
    return good, n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], sum(exact[i][i] for i in range(size))


def check(result, rows, tolerance=1e-9):
    good, n, sums, values, vectors, trace = brute(rows)
    got = {}
    for r in result.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    count = len(values)
    assert sum(map(len, got.values())) == count * len(good)
    expected: dict = {}
    for i, v in good:
        moved = [n * a - s for a, s in zip(v, sums, strict=True)]
        for k in range(count):
            w = float(np.array(moved, float) @ vectors[:, k]) / n / math.sqrt(values[k])
            expected.setdefault((i, k + 1), []).append((sum(m * m for m in moved), w))
    for k in range(1, count + 1):
        sign = None
        for key in (x for x in expected if x[1] == k):
            mine = sorted(got[key], key=lambda r: (r.deviation, r.whitened))
            sign = sign or (np.sign(mine[0].whitened * expected[key][0][1]) if len(mine) == 1 and abs(expected[key][0][1]) > 1e-3 else None)
            for r, (deviation, w) in zip(mine, sorted((d, (sign or 1) * w) for d, w in expected[key]), strict=True):
                assert (r.n, r.deviation) == (n, deviation)
                assert abs(r.whitened - w) < tolerance
                assert abs(r.explained - values[k - 1] / trace) <= 1e-9
                assert r.identity_error < 1e-9


def test_against_plain_loops(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1 + k) for k in range(7)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a common vector counts once in the fit
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)), rows)


def test_query_against_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op13_embedding_whitening(spark, folder), rows, 1e-8)


def test_large_values_stay_exact(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1, 1]) * (10.0 ** k + rng.random()) for k in range(3, 6)]) for i in range(60)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)
    huge = [(i, [rng.choice([-1, 1]) * rng.random() * 1e16, rng.random()]) for i in range(30)]
    result = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    good, n, sums, values, _, trace = brute(huge)
    assert all(r.deviation is None or r.deviation < 1 << 63 for r in result) and any(r.deviation is None for r in result)
    assert abs(result[0].explained - values[0] / trace) < 1e-9


def test_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, component string, x int, n long"
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 1.0, 2.0]), (4, [inf, 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (6, [-0.0, 0.5, 0.25]),
            (6, [-0.0, 0.5, 0.25]), (7, [0.25, -1.0]), (8, []), (9, [3.0, 1.0, -1.0]), (10, [0.0, 2.0, 5.0])]
    frame = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema)
    result = whitening.whiten(frame)
    assert sorted(r.vec_id or 0 for r in result.collect() if r.component == 1) == [0, 6, 6, 7, 8, 9, 10]
    check(result, rows)


def test_too_few_vectors(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, []), (2, [])]) == []
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in one)
    two = run([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])
    assert [round(abs(r.whitened), 9) if r.whitened is not None else None for r in two if r.vec_id == 1] == [1.0, None, None]
    assert all(r.identity_error < 1e-9 for r in two) and two[0].explained == 1.0
