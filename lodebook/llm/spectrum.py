"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of D in an LDLᵀ factorisation of A - sI tell how many eigenvalues lie above s. Bisection on these counts isolates
each leading eigenvalue, Rayleigh quotient iteration then converges cubically, and counts on both sides of the result
certify its number. Works on one small matrix in memory; nothing here knows Spark.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
ALPHA = (1 + math.sqrt(17)) / 8  # bounds the growth of Bunch and Kaufman's pivoting
STEPS = 60


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than the shift: positive pivots, one of each pair of a 2 x 2 pivot."""
    a = matrix - shift * np.eye(len(matrix))
    positive, k, size = 0, 0, len(a)
    while k < size:
        below = np.abs(a[k + 1:, k])
        most = float(below.max()) if len(below) else 0.0
        own = abs(a[k, k])
        if own == 0 and most == 0:
            k += 1
            continue
        pick, wide = k, 1
        if own < ALPHA * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            across = float(row.max())
            if own * across < ALPHA * most * most:
                pick = r
                wide = 1 if abs(a[r, r]) >= ALPHA * across else 2
        to = k + wide - 1
        if pick != to:
            a[[to, pick]] = a[[pick, to]]
            a[:, [to, pick]] = a[:, [pick, to]]
        rest, block = a[k + wide:, k:k + wide], a[k:k + wide, k:k + wide]
        if wide == 1:
            positive += block[0, 0] > 0
            a[k + 1:, k + 1:] -= np.outer(rest[:, 0] / block[0, 0], rest[:, 0])
        else:
            positive += 1
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
        k += wide
    return positive


def _isolate(matrix: np.ndarray, number: int, low: float, high: float, tolerance: float) -> tuple[float, float]:
    """Bounds with `number` eigenvalues or more above the lower one and fewer above the upper one.

    Narrowed until the eigenvalue is alone between them or they are as close as rounding allows.
    """
    above_low, above_high = count_above(matrix, low), count_above(matrix, high)
    while high - low > tolerance and (above_low > number or above_high < number - 1):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        count = count_above(matrix, middle)
        if count >= number:
            low, above_low = middle, count
        else:
            high, above_high = middle, count
    return low, high


def _iterate(matrix: np.ndarray, found: np.ndarray, low: float, high: float, seed: int) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from the middle of the bounds, orthogonal to the vectors found before."""
    size = len(matrix)

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found @ (found.T @ v)
        return v / np.linalg.norm(v)

    def solve(shift: float, v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            for nudge in (0.0, EPS, 16 * EPS, 1024 * EPS):
                try:
                    y = np.linalg.solve(matrix - (shift + nudge * max(abs(high), abs(low), 1e-300)) * np.eye(size), v)
                except np.linalg.LinAlgError:
                    continue
                if np.isfinite(y).all() and np.linalg.norm(y) > 0:
                    return clean(y / np.abs(y).max())
        return v

    v = clean(np.random.default_rng(seed).standard_normal(size))
    for _ in range(3):
        v = solve((low + high) / 2, v)
    best = (math.inf, 0.0, v)
    for _ in range(STEPS):
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if residual >= best[0] and best[0] < math.inf:
            break
        best = (residual, value, v)
        v = solve(value, v)
    return best[1], best[2], best[0]


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit vectors as columns (fewer if the matrix is smaller).

    The entry of a vector with the largest size is positive. Equal eigenvalues get any orthonormal vectors of their space.
    A result whose number cannot be certified raises ArithmeticError.
    """
    size = len(matrix)
    count = min(count, size)
    scale = float(np.abs(matrix).max()) if size else 0.0
    if scale == 0:
        return np.zeros(count), np.eye(size)[:, :count]
    a = matrix / scale
    reach = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - reach).min()) - 1e-6, float((np.diag(a) + reach).max()) + 1e-6
    tolerance = 8 * EPS * max(abs(low), abs(high))
    values, vectors = np.zeros(count), np.zeros((size, 0))
    top = high
    for number in range(1, count + 1):
        left, right = _isolate(a, number, low, top, tolerance)
        slack = size * tolerance
        for attempt in range(STEPS):
            value, vector, residual = _iterate(a, vectors, left, right, 17 * number + attempt)
            if left - slack <= value <= right + slack and residual <= max(slack, 1e-12):
                break
            middle = (left + right) / 2  # came to a neighbour: halve the bounds and begin again
            if count_above(a, middle) >= number:
                left = middle
            else:
                right = middle
        margin = max(slack, 2 * residual)
        if count_above(a, value - margin) < number or count_above(a, value + margin) > number - 1:
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        if vector[np.abs(vector).argmax()] < 0:
            vector = -vector
        values[number - 1] = value
        vectors = np.column_stack([vectors, vector])
        top = min(high, value + margin)
    return values * scale, vectors
