"""Square matrices of any size, many at a time: every step of an algorithm is one NumPy operation over all matrices of an Arrow batch.

Elimination with row exchanges gives determinants and inverses, cyclic Jacobi rotations the eigenvalues of symmetric matrices.
"""

from __future__ import annotations

import numpy as np

#: Sweeps of rotations after which eigenvalues are as good as their arithmetic allows; they converge quadratically, in far fewer.
MOST_SWEEPS = 40


def _pivot(a: np.ndarray, k: int, other: np.ndarray | None = None) -> np.ndarray:
    """Exchange row k with the one below that has the largest entry in column k, in place; tells where rows changed."""
    each, row = np.arange(len(a)), k + np.abs(a[:, k:, k]).argmax(1)
    for m in (a,) if other is None else (a, other):
        m[each, k], m[each, row] = m[each, row].copy(), m[each, k].copy()
    return row != k


def determinants(matrices: np.ndarray) -> np.ndarray:
    """Determinants (cell) of matrices (cell, row, column)."""
    a = matrices.astype(float).copy()
    out = np.ones(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            out = np.where(_pivot(a, k), -out, out)
            lead = a[:, k, k]
            out = out * lead
            # A column of zeros makes the determinant 0 whatever follows.
            share = np.where(lead[:, None] != 0, a[:, k + 1 :, k] / lead[:, None], 0.0)
            a[:, k + 1 :, k:] -= share[:, :, None] * a[:, k : k + 1, k:]
    return out


def inverses(matrices: np.ndarray) -> np.ndarray:
    """Inverses of matrices; a singular one is an error."""
    a, n = matrices.astype(float).copy(), matrices.shape[1]
    out = np.broadcast_to(np.eye(n), a.shape).copy()
    for k in range(n):
        _pivot(a, k, out)
        lead = a[:, k, k].copy()
        if (lead == 0).any():
            raise ZeroDivisionError("inverse of a singular matrix")
        a[:, k] /= lead[:, None]
        out[:, k] /= lead[:, None]
        share = a[:, :, k].copy()
        share[:, k] = 0.0
        a -= share[:, :, None] * a[:, k : k + 1]
        out -= share[:, :, None] * out[:, k : k + 1]
    return out


def symmetric_eigenvalues(matrices: np.ndarray) -> np.ndarray:
    """Eigenvalues (cell, rising) of symmetric matrices, of which the lower triangle is read. Not-a-number and infinite entries give not-a-number."""
    n = matrices.shape[1]
    low = np.tril(matrices.astype(float))
    a = low + np.tril(low, -1).transpose(0, 2, 1)
    # Entries are brought to at most 1, so that no square passes the range of numbers.
    scale = np.abs(a).max((1, 2), initial=0.0)
    scale = np.where((scale > 0) & np.isfinite(scale), scale, 1.0)
    with np.errstate(invalid="ignore"):
        a /= scale[:, None, None]
        size = np.sqrt((a * a).sum((1, 2)))
    for _ in range(MOST_SWEEPS):
        off = np.sqrt(np.maximum((np.tril(a, -1) ** 2).sum((1, 2)), 0.0))
        with np.errstate(invalid="ignore"):
            turning = off > 1e-17 * size
        if not turning.any():
            break
        b = a[turning]
        for p in range(n - 1):
            for q in range(p + 1, n):
                _rotate(b, p, q)
        a[turning] = b
    out = np.sort(a[:, range(n), range(n)], axis=1) * scale[:, None]
    out[~np.isfinite(size)] = np.nan
    return out


def _rotate(a: np.ndarray, p: int, q: int) -> None:
    """Turn the plane of axes p and q of every matrix so that its entry (p, q) vanishes, in place."""
    apq = a[:, p, q]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ratio = (a[:, q, q] - a[:, p, p]) / (2.0 * apq)
        # The smaller of the two angles; none where the entry is 0 already, or so small beside the diagonal that its ratio is infinite.
        t = np.where(apq != 0, np.copysign(1.0, ratio) / (np.abs(ratio) + np.sqrt(ratio * ratio + 1.0)), 0.0)
    t = np.where(np.isfinite(t), t, 0.0)
    c = 1.0 / np.sqrt(t * t + 1.0)
    s = (t * c)[:, None]
    c = c[:, None]
    rows_p, rows_q = a[:, p].copy(), a[:, q].copy()
    a[:, p], a[:, q] = c * rows_p - s * rows_q, s * rows_p + c * rows_q
    columns_p, columns_q = a[:, :, p].copy(), a[:, :, q].copy()
    a[:, :, p], a[:, :, q] = c * columns_p - s * columns_q, s * columns_p + c * columns_q
