"""Leading eigenvalues and eigenvectors of a symmetric matrix: Householder tridiagonalisation, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit reflectors) of Q^T A Q, by Householder reflections."""
    a = np.array(matrix, np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        rest = np.linalg.norm(v[1:])
        if rest == 0:
            reflectors.append(np.zeros(len(v)))
            continue
        v[0] += np.copysign(np.hypot(v[0], rest), v[0])
        v /= np.linalg.norm(v)
        # Two-sided reflection of the trailing block as one symmetric update of rank two.
        block = a[k + 1:, k + 1:]
        p = 2 * (block @ v)
        p -= (v @ p) * v
        block -= np.outer(v, p) + np.outer(p, v)
        edge = a[k + 1:, k]
        edge -= 2 * (v @ edge) * v
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def back(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Columns in the tridiagonal matrix's space, carried back by the reflections in reverse."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        out[k + 1:] -= 2 * np.outer(v, v @ out[k + 1:])
    return out


def counts_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of the shifted matrix (Sturm)."""
    found, pivot, square = np.zeros(len(shifts), np.int64), np.ones(len(shifts)), 0.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - square / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        found += pivot < 0
        square = off[k] ** 2 if k < len(off) else 0.0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection on Sturm counts until the bounds are neighbours."""
    n = len(diagonal)
    around = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    size = max(np.abs(diagonal).max() + around.max(), np.finfo(np.float64).tiny)
    least = np.finfo(np.float64).tiny / EPS * max(1.0, (off ** 2).max() if len(off) else 1.0)
    wanted = n - np.arange(count)  # the k-th largest is the value below which n - k eigenvalues lie
    low = np.full(count, (diagonal - around).min() - 2 * n * EPS * size)
    high = np.full(count, (diagonal + around).max() + 2 * n * EPS * size)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > EPS * (np.abs(low) + np.abs(high)) / 2 + least)
        if not open_.any():
            return middle
        enough = counts_below(diagonal, off, middle, least) >= wanted
        high = np.where(open_ & enough, middle, high)
        low = np.where(open_ & ~enough, middle, low)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Elimination with row exchanges of the shifted matrix; returns a function that solves for one right side."""
    n = len(diagonal)
    a, b = diagonal - shift, np.append(off, 0.0)
    pivots, right, further, swaps, factors = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n)
    now, beside = a[0], b[0]
    for k in range(n - 1):
        below = off[k]
        if abs(now) >= abs(below):
            now = now if abs(now) > least else np.copysign(least, now)
            pivots[k], right[k], further[k], factors[k] = now, beside, 0.0, below / now
            now, beside = a[k + 1] - factors[k] * beside, b[k + 1]
        else:
            swaps[k] = True
            pivots[k], right[k], further[k], factors[k] = below, a[k + 1], b[k + 1], now / below
            now, beside = beside - factors[k] * a[k + 1], -factors[k] * b[k + 1]
    pivots[-1] = now if abs(now) > least else np.copysign(least, now)

    def solve(x: np.ndarray) -> np.ndarray:
        y = x.copy()
        for k in range(n - 1):
            if swaps[k]:
                y[k], y[k + 1] = y[k + 1], y[k]
            y[k + 1] -= factors[k] * y[k]
        out = np.zeros(n + 2)
        for k in range(n - 1, -1, -1):
            out[k] = (y[k] - right[k] * out[k + 1] - further[k] * out[k + 2]) / pivots[k]
        return out[:n]

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A unit eigenvector per value, as columns, by inverse iteration; those of a cluster are made orthogonal in each round."""
    n = len(diagonal)
    size = np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0.0)
    least = max(EPS * size, np.finfo(np.float64).tiny)
    near = 1e-3 * size
    rng = np.random.default_rng(17)
    out = np.zeros((n, len(values)))
    first, last = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > near:
            first = k
        # Equal values are set a hair apart, so that elimination does not meet the same matrix again.
        shift = min(value, last - 10 * least) if k > first else value
        last = shift
        solve = _solver(diagonal, off, shift, least)
        x = rng.uniform(-1, 1, n)
        for _ in range(rounds):
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x = solve(x / np.linalg.norm(x))
        for _ in range(2):
            x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    count = min(count, len(matrix))
    if not np.any(matrix):
        return np.zeros(count), np.eye(len(matrix))[:, :count]
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, count)
    vectors = back(vectors_of(diagonal, off, values), reflectors)
    # The quotient of the matrix itself takes out what the reduction rounded away.
    return np.einsum("ij,ij->j", vectors, matrix @ vectors), vectors
