"""Linear algebra on a square matrix per cell: closed forms up to 3 x 3, elimination and rotations over whole Arrow batches beyond."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.registry import operator
from fieldweave.operators.batched import determinants, inverses, symmetric_eigenvalues
from fieldweave.operators.pointwise import need
from fieldweave.plans.workspace import Value


def _rows(v: Value) -> list[list[Column]]:
    return [list(v.columns[r * v.size : (r + 1) * v.size]) for r in range(v.size)]


def _det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _batched(v: Value, f, result: str):
    """A function of all matrices of a batch (cell, row, column), for sizes without a closed form."""
    size = v.size

    @F.arrow_udf(result)
    def run(cells: pa.Array) -> pa.Array:
        out = f(cells.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cells), size, size)).reshape(len(cells), -1)
        if result == "double":
            return pa.array(out[:, 0])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return run(F.array(*v.columns))


@operator("trace", cost="low")
def _trace(ws, node, m):
    """sum of the diagonal"""
    need("trace", m, "matrix")
    return Value("scalar", (sum((m.columns[k * m.size + k] for k in range(m.size)), F.lit(0.0)),))


@operator("determinant", cost="high")
def _determinant(ws, node, m):
    """determinant; if any diagonal entry anywhere is below 1e-12, every matrix first gets 1e-12 on its diagonal. NaN becomes 0, values stay within 1e30"""
    need("determinant", m, "matrix")
    m = Value("matrix", ws.keep(*m.columns), m.size)
    small = F.lit(False)
    for k in range(m.size):
        small = small | (F.abs(m.columns[k * m.size + k]) < 1e-12)
    shift = ws.number(F.coalesce(F.max(F.when(small, F.lit(1e-12)).otherwise(F.lit(0.0))), F.lit(0.0)))
    shifted = tuple(c + shift if k // m.size == k % m.size else c for k, c in enumerate(m.columns))
    v = Value("matrix", shifted, m.size)
    det = _det(_rows(v)) if m.size <= 3 else _batched(v, determinants, "double")
    det = F.when(F.isnan(det), F.lit(0.0)).otherwise(F.least(F.greatest(det, F.lit(-1e30)), F.lit(1e30)))
    return Value("scalar", (det,))


@operator("eigenvalues", cost="very_high")
def _eigenvalues(ws, node, m):
    """eigenvalues of a symmetric matrix (its lower triangle), rising"""
    need("eigenvalues", m, "matrix")
    c = ws.keep(*m.columns)
    at = lambda r, k: c[max(r, k) * m.size + min(r, k)]
    if m.size == 1:
        return Value("vector", (at(0, 0),), 1)
    if m.size == 2:
        mid, half = (at(0, 0) + at(1, 1)) / 2, (at(0, 0) - at(1, 1)) / 2
        r = F.sqrt(half * half + at(1, 0) * at(1, 0))
        return Value("vector", (mid - r, mid + r), 2)
    if m.size == 3:
        q = (at(0, 0) + at(1, 1) + at(2, 2)) / 3
        off = at(1, 0) * at(1, 0) + at(2, 0) * at(2, 0) + at(2, 1) * at(2, 1)
        spread = sum(((at(k, k) - q) * (at(k, k) - q) for k in range(3)), F.lit(0.0)) + 2 * off
        p = F.sqrt(spread / 6)
        flat = p < 1e-150
        safe = F.when(flat, F.lit(1.0)).otherwise(p)
        b = [[(at(r, k) - q) / safe if r == k else at(r, k) / safe for k in range(3)] for r in range(3)]
        angle = F.acos(F.least(F.greatest(_det(b) / 2, F.lit(-1.0)), F.lit(1.0))) / 3
        (high, low, q) = ws.keep(q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * math.pi / 3), q)
        return Value("vector", (low, 3 * q - high - low, high), 3)
    out = ws.keep(_batched(Value("matrix", c, m.size), symmetric_eigenvalues, "array<double>"))[0]
    return Value("vector", tuple(out[k] for k in range(m.size)), m.size)


@operator("inverse", cost="very_high")
def _inverse(ws, node, m):
    """inverse; a singular matrix is an error"""
    need("inverse", m, "matrix")
    v = Value("matrix", ws.keep(*m.columns), m.size)
    if m.size > 3:
        out = ws.keep(_batched(v, inverses, "array<double>"))[0]
        return Value("matrix", tuple(out[k] for k in range(m.size**2)), m.size)
    rows = _rows(v)
    (det,) = ws.keep(_det(rows))
    det = F.when(det == 0, F.raise_error(F.lit("inverse of a singular matrix")).cast("double")).otherwise(det)
    if m.size == 1:
        return Value("matrix", (F.lit(1.0) / det,), 1)

    def minor(r, k):
        return _det([[rows[i][j] for j in range(m.size) if j != k] for i in range(m.size) if i != r])

    return Value("matrix", tuple((minor(k, r) if (r + k) % 2 == 0 else -minor(k, r)) / det for r in range(m.size) for k in range(m.size)), m.size)


@operator("deviatoric", cost="medium")
def _deviatoric(ws, node, m):
    """matrix less a third (or 1/D) of its trace on the diagonal; NaN and infinities become 0"""
    need("deviatoric", m, "matrix")
    mean = sum((m.columns[k * m.size + k] for k in range(m.size)), F.lit(0.0)) / m.size
    out = (c - mean if k // m.size == k % m.size else c for k, c in enumerate(m.columns))
    return Value("matrix", tuple(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c) for c in out), m.size)


@operator("matmul_batched_custom", cost="high")
def _times_transposed(ws, node, m):
    """the matrix times its own transpose"""
    need("matmul_batched_custom", m, "matrix")
    rows = _rows(Value("matrix", ws.keep(*m.columns), m.size))
    return Value("matrix", tuple(sum((a * b for a, b in zip(r, k)), F.lit(0.0)) for r in rows for k in rows), m.size)
