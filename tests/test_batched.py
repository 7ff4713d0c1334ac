"""Batched elimination and rotations against NumPy's, and matrices of more than three rows in expressions."""

import numpy as np
import pytest
from grids import to_array, to_field

from fieldweave import evaluate
from fieldweave.operators.batched import determinants, inverses, symmetric_eigenvalues

RNG = np.random.default_rng(10)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 13])
def test_against_numpy(n):
    a = RNG.normal(size=(200, n, n))
    a[0], a[1] = np.eye(n), 0.0
    a[2, 0] = 0.0
    a[3] = np.eye(n)[::-1]
    assert np.allclose(determinants(a), np.linalg.det(a), rtol=1e-9, atol=1e-12)
    well = a[4:] + 3 * n * np.eye(n)
    assert np.allclose(inverses(well), np.linalg.inv(well), rtol=1e-10, atol=1e-12)
    s = a + a.transpose(0, 2, 1)
    s[4], s[5] = 1e200 * s[4], 1e-200 * s[5]
    want = np.linalg.eigvalsh(s)
    scale = np.abs(want).max(1, keepdims=True) + 1e-300
    assert np.allclose(symmetric_eigenvalues(s) / scale, want / scale, atol=1e-12)
    # Only the lower triangle is read.
    assert np.array_equal(symmetric_eigenvalues(np.tril(s)), symmetric_eigenvalues(s))


def test_permutations_and_singular_matrices():
    p = np.eye(5)[[3, 1, 4, 0, 2]][None]
    assert determinants(p)[0] == np.linalg.det(p[0]) and np.array_equal(inverses(p)[0], p[0].T)
    with pytest.raises(ZeroDivisionError):
        inverses(np.stack([np.eye(4), np.zeros((4, 4))]))
    assert determinants(np.zeros((0, 4, 4))).shape == (0,) and symmetric_eigenvalues(np.zeros((0, 4, 4))).shape == (0, 4)
    bad = np.stack([np.eye(3), np.full((3, 3), np.nan)])
    got = symmetric_eigenvalues(bad)
    assert np.array_equal(got[0], [1, 1, 1]) and np.isnan(got[1]).all()


@pytest.mark.parametrize("n", [4, 8])
def test_expressions(spark, n):
    a = RNG.normal(size=(4, 3, n, n)) + n * np.eye(n)
    f = {"m": to_field(spark, a, "matrix", n)}
    assert np.allclose(to_array(evaluate("determinant(m)", f)), np.linalg.det(a))
    assert np.allclose(to_array(evaluate("inverse(m)", f)).reshape(a.shape), np.linalg.inv(a))
    s = np.tril(a) + np.tril(a, -1).swapaxes(-1, -2)
    assert np.allclose(to_array(evaluate("eigenvalues(m)", f)), np.linalg.eigvalsh(s))


def test_a_singular_matrix_is_an_error(spark):
    f = {"m": to_field(spark, np.zeros((2, 4, 4)), "matrix", 4)}
    with pytest.raises(Exception, match="singular"):
        evaluate("inverse(m)", f).df.collect()
