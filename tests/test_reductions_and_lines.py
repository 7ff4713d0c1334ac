"""Reductions, integrals, linear algebra, transforms and distances against NumPy."""

import numpy as np
import pytest
from grids import to_array, to_field

from fieldweave import evaluate
from fieldweave.operators import reduce as reductions

RNG = np.random.default_rng(3)
A = RNG.normal(size=(5, 4, 3))


def number(spark, expression, a=A, **more):
    return evaluate(expression, {"f": to_field(spark, a), **more}).value


def test_numbers(spark):
    g = to_field(spark, A**2)
    assert np.isclose(number(spark, "sum(f)"), A.sum()) and np.isclose(number(spark, "mean(f)"), A.mean())
    assert np.isclose(number(spark, "norm_l2(f)"), np.linalg.norm(A)) and number(spark, "min_max(f)") == (A.min(), A.max())
    assert np.isclose(number(spark, "variance(f)"), A.var(ddof=1)) and np.isclose(number(spark, "var(f, unbiased=False)"), A.var())
    assert np.isclose(number(spark, "cov(f, g)", g=g), np.cov(A.ravel(), (A**2).ravel())[0, 1])
    assert np.isclose(number(spark, "corr(f, g)", g=g), np.corrcoef(A.ravel(), (A**2).ravel())[0, 1])
    p = np.abs(A) / np.abs(A).sum()
    assert np.isclose(number(spark, "entropy(f)"), -(p * np.log(p + 1e-15)).sum())


def test_one_cell_and_constants(spark):
    one = np.ones((1,))
    assert np.isnan(number(spark, "variance(f)", one)) and number(spark, "var(f, unbiased=False)", one) == 0
    assert number(spark, "cov(f, f)", one) == 0 and number(spark, "corr(f, f)", np.ones((4,))) == 0
    assert number(spark, "integrate(f)", one) == 0


@pytest.mark.parametrize("dim", [0, 1, 2, -1])
def test_axes(spark, dim):
    f = {"f": to_field(spark, A)}
    assert np.allclose(to_array(evaluate(f"sum(f, dim={dim})", f)), A.sum(dim))
    assert np.allclose(to_array(evaluate(f"variance(f, dim={dim})", f)), A.var(dim, ddof=1))
    assert np.allclose(to_array(evaluate(f"f - mean(f, dim={dim}, keepdim=True)", f)), A - A.mean(dim, keepdims=True))
    p = np.abs(A) / np.abs(A).sum(dim, keepdims=True)
    assert np.allclose(to_array(evaluate(f"entropy(f, dim={dim})", f)), -(p * np.log(p + 1e-15)).sum(dim))


def simpson(y, h):
    n = len(y)
    if n == 1:
        return 0.0
    if n < 3:
        return h * (y[0] + y[1]) / 2
    m = n if n % 2 else n - 1
    s = h / 3 * (y[0] + y[m - 1] + 4 * y[1 : m - 1 : 2].sum() + 2 * y[2 : m - 1 : 2].sum())
    return s if n % 2 else s + h * (y[-2] + y[-1]) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_integrate(spark, n):
    y = RNG.normal(size=n)
    f = {"f": to_field(spark, y)}
    assert np.isclose(evaluate("integrate(f, dx=0.5)", f).value, simpson(y, 0.5))
    assert np.isclose(evaluate('integrate(f, dx=2, method="trapezoid")', f).value, np.trapezoid(y, dx=2))
    c = to_array(evaluate("cumulative_integral(f, dx=0.5)", f))
    assert np.allclose(c, np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) * 0.25)])[: n])


def test_cumulative_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(reductions, "BLOCK_CELLS", 4)
    a = RNG.normal(size=(11, 3))
    got = to_array(evaluate("cumulative_integral(f)", {"f": to_field(spark, a)}))
    assert np.allclose(got, np.concatenate([np.zeros((1, 3)), np.cumsum((a[1:] + a[:-1]) / 2, axis=0)]))
    line = to_array(evaluate("cumulative_integral(f)", {"f": to_field(spark, a[:, 0])}))
    assert np.allclose(line, got[:, 0])


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_linear_algebra(spark, size):
    m = RNG.normal(size=(6, size, size))
    f = {"m": to_field(spark, m, "matrix", size)}
    back = lambda e: to_array(evaluate(e, f)).reshape(6, -1)
    assert np.allclose(back("trace(m)")[:, 0], np.trace(m, axis1=1, axis2=2)) and np.allclose(back("determinant(m)")[:, 0], np.linalg.det(m))
    assert np.allclose(back("inverse(m)"), np.linalg.inv(m).reshape(6, -1), atol=1e-8)
    assert np.allclose(back("matmul_batched_custom(m)"), (m @ m.transpose(0, 2, 1)).reshape(6, -1))
    dev = m - np.trace(m, axis1=1, axis2=2)[:, None, None] / size * np.eye(size)
    assert np.allclose(back("deviatoric(m)"), dev.reshape(6, -1)) and np.allclose(back("trace(deviatoric(m))"), 0, atol=1e-12)
    s = (m + m.transpose(0, 2, 1)) / 2
    got = to_array(evaluate("eigenvalues(m)", {"m": to_field(spark, s, "matrix", size)})).reshape(6, -1)
    assert np.allclose(got, np.linalg.eigvalsh(s), atol=1e-7)


def test_degenerate_matrices(spark):
    m = np.stack([np.eye(3), np.zeros((3, 3)), np.diag([1.0, 1.0, 2.0])])
    f = {"m": to_field(spark, m, "matrix", 3)}
    assert np.allclose(to_array(evaluate("eigenvalues(m)", f)), [[1, 1, 1], [0, 0, 0], [1, 1, 2]], atol=1e-7)
    assert np.allclose(to_array(evaluate("determinant(m)", f)), [1, 1e-36, 2], atol=1e-11)
    with pytest.raises(Exception, match="singular"):
        evaluate("inverse(m)", f).df.collect()


@pytest.mark.parametrize("norm", ["backward", "ortho", "forward"])
def test_transforms(spark, norm):
    f = {"f": to_field(spark, A)}
    z = to_array(evaluate(f'fft(f, norm="{norm}")', f))
    assert np.allclose(z[..., 0] + 1j * z[..., 1], np.fft.fftn(A, norm=norm))
    assert np.allclose(to_array(evaluate(f'ifft(fft(f, norm="{norm}"), norm="{norm}")', f)), A, atol=1e-10)
    if norm == "ortho":
        assert np.isclose((z**2).sum(), (A**2).sum())


def test_spectral_derivatives(spark):
    n = 64
    y = np.sin(2 * np.pi * np.arange(n) / n)
    f = {"f": to_field(spark, y)}
    assert np.allclose(to_array(evaluate(f"spectral_gradient(f, dx={1 / n})", f)), 2 * np.pi * np.cos(2 * np.pi * np.arange(n) / n), atol=1e-9)
    assert np.allclose(to_array(evaluate(f"spectral_laplacian(f, dx={1 / n})", f)), -((2 * np.pi) ** 2) * y, atol=1e-7)


def test_distances(spark):
    def brute(a, h):
        at = np.argwhere(a != 0)
        out = np.zeros(a.shape)
        for i in np.argwhere(a == 0):
            out[tuple(i)] = np.sqrt((((at - i) * h) ** 2).sum(1).min())
        return out

    a = (RNG.random((7, 6, 5)) < 0.03).astype(float)
    a[3, 3, 3] = 1
    got = to_array(evaluate("distance_transform(f, dx=(1, 2, 0.5))", {"f": to_field(spark, a)}))
    assert np.allclose(got, brute(a, np.array([1, 2, 0.5])))
    assert np.isnan(to_array(evaluate("distance_transform(f)", {"f": to_field(spark, np.zeros((3, 3)))}))).all()
