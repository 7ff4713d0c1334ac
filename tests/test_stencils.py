"""Stencils against NumPy, under every boundary, and across blocks of the grid."""

import grids
import numpy as np
import pytest
from grids import to_array, to_field
from pyspark.sql import functions as F

from fieldweave import evaluate, from_function
from fieldweave.operators import stencil, taps
from fieldweave.plans.expression import ExpressionError

@pytest.fixture(autouse=True, params=[False, True], ids=["blocks", "partial_sums"])
def both_ways(request, monkeypatch):
    """Every test over frames in no known order, which go by blocks, and over ordered ones, which go by partial sums."""
    monkeypatch.setattr(grids, "IN_ORDER", request.param)
    monkeypatch.setattr(taps, "MOST_SHARES", 10**6)


PAD = {"periodic": "wrap", "neumann": "edge", "dirichlet": "constant", "reflect": "reflect"}
RNG = np.random.default_rng(1)


def laplacian(a, boundary, h=1.0):
    out = np.zeros_like(a)
    for d in range(a.ndim):
        p = np.moveaxis(np.pad(a, [(1, 1) if e == d else (0, 0) for e in range(a.ndim)], mode=PAD[boundary]), d, 0)
        out += np.moveaxis((p[2:] + p[:-2] - 2 * p[1:-1]) / h**2, 0, d)
    return out


@pytest.mark.parametrize("boundary", PAD)
@pytest.mark.parametrize("shape", [(11,), (6, 5), (4, 3, 5)])
def test_laplacian(spark, boundary, shape):
    a = RNG.normal(size=shape)
    got = to_array(evaluate("laplacian(f)", {"f": to_field(spark, a)}, dx=0.5, boundary=boundary))
    assert np.allclose(got, laplacian(a, boundary, 0.5), atol=1e-12)


@pytest.mark.parametrize("boundary", PAD)
def test_blocks_do_not_show(spark, boundary, monkeypatch):
    """Small blocks, so that ghosts cross faces and, when periodic, the ends."""
    monkeypatch.setattr(stencil, "BLOCK_CELLS", 16)
    a = RNG.normal(size=(13, 11))
    f = to_field(spark, a)
    assert np.allclose(to_array(evaluate("laplacian(f)", {"f": f}, boundary=boundary)), laplacian(a, boundary), atol=1e-12)
    assert np.allclose(to_array(evaluate("gradient(f)", {"f": f})), np.stack(np.gradient(a, edge_order=2), -1), atol=1e-12)
    assert np.allclose(to_array(evaluate("laplacian(laplacian(f))", {"f": f}, boundary=boundary)), laplacian(laplacian(a, boundary), boundary), atol=1e-11)


def test_partitioning_does_not_show(spark):
    a = RNG.normal(size=(9, 7))
    f = to_field(spark, a)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = to_array(evaluate("curl(gradient(f)) + mean(f)", {"f": f}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(many, to_array(evaluate("curl(gradient(f)) + mean(f)", {"f": f})), atol=1e-14)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("boundary", PAD)
def test_short_axes(spark, n, boundary):
    a = RNG.normal(size=(n, 4))
    f = to_field(spark, a)
    got = to_array(evaluate("laplacian(f)", {"f": f}, boundary=boundary))
    if n > 1 or boundary != "reflect":
        assert np.allclose(got, laplacian(a, boundary), atol=1e-12)
    one = to_array(evaluate("gradient(f, dim=0)", {"f": f}))
    want = np.zeros_like(a) if n == 1 else np.gradient(a, axis=0, edge_order=2 if n > 2 else 1)
    assert np.allclose(one, want, atol=1e-12)


def test_exact_on_quadratics(spark):
    x, y, z = (F.col(f"i{d}") for d in range(3))
    f = from_function(spark, (9, 9, 9), x * x + y * y + z * z)
    g = to_array(evaluate("gradient(f)", {"f": f}))
    i = np.stack(np.meshgrid(*[np.arange(9.0)] * 3, indexing="ij"), -1)
    assert np.allclose(g, 2 * i, atol=1e-11)
    w = evaluate("gradient(f)", {"f": f}).field
    assert np.allclose(to_array(evaluate("divergence(w)", {"w": w})), 6, atol=1e-11)


def test_vector_calculus(spark):
    x, y, z = (F.col(f"i{d}").cast("double") for d in range(3))
    spin = from_function(spark, (9, 9, 9), -y, x, 0.0 * z, kind="vector", size=3)
    assert np.allclose(to_array(evaluate("curl(w)", {"w": spin})), [0, 0, 2], atol=1e-11)
    assert np.allclose(to_array(evaluate("divergence(w)", {"w": spin})), 0, atol=1e-11)
    a = RNG.normal(size=(5, 6, 4))
    f = {"f": to_field(spark, a)}
    assert np.allclose(to_array(evaluate("curl(gradient(f))", f)), 0, atol=1e-10)
    b = to_field(spark, RNG.normal(size=(5, 6, 4, 3)), "vector", 3)
    assert np.allclose(to_array(evaluate("divergence(curl(w))", {"w": b})), 0, atol=1e-10)
    assert abs(evaluate("sum(laplacian(f))", f, boundary="periodic").value) < 1e-9


def test_hessian_jacobian_curvature(spark):
    a = RNG.normal(size=(5, 4, 6))
    h = to_array(evaluate("hessian(f)", {"f": to_field(spark, a)})).reshape(*a.shape, 3, 3)
    for i in range(3):
        for j in range(3):
            assert np.allclose(h[..., i, j], np.gradient(np.gradient(a, axis=i, edge_order=2), axis=j, edge_order=2), atol=1e-11)
    w = RNG.normal(size=(4, 5, 3, 3))
    j = to_array(evaluate("jacobian(w)", {"w": to_field(spark, w, "vector", 3)})).reshape(4, 5, 3, 3, 3)
    for c in range(3):
        assert np.allclose(j[..., c, :], np.stack(np.gradient(w[..., c], edge_order=2), -1), atol=1e-11)
    g = np.stack(np.gradient(a, edge_order=2), -1)
    unit = g / np.maximum(np.linalg.norm(g, axis=-1, keepdims=True), 1e-15)
    want = sum(np.gradient(unit[..., d], axis=d, edge_order=2) for d in range(3))
    assert np.allclose(to_array(evaluate("mean_curvature(f)", {"f": to_field(spark, a)})), want, atol=1e-10)


@pytest.mark.parametrize("window", [1, 3, 5])
@pytest.mark.parametrize("boundary", PAD)
def test_moving_average(spark, window, boundary):
    a = RNG.normal(size=(7, 6))
    want, r = a, window // 2
    for d in range(2):
        p = np.pad(want, [(r, r) if e == d else (0, 0) for e in range(2)], mode=PAD[boundary])
        want = sum(np.take(p, range(o, o + a.shape[d]), axis=d) for o in range(window)) / window
    got = to_array(evaluate(f'moving_average(f, window={window}, boundary="{boundary}")', {"f": to_field(spark, a)}))
    assert np.allclose(got, want, atol=1e-12)


def test_gauss_is_a_circular_convolution(spark):
    a = RNG.normal(size=(5, 4, 6))
    k = np.array([1, 2, 1]) / 4
    want = a
    for d in range(3):
        want = k[0] * np.roll(want, 1, d) + k[1] * want + k[2] * np.roll(want, -1, d)
    assert np.allclose(to_array(evaluate("conv3d_spectral(f)", {"f": to_field(spark, a)})), want, atol=1e-12)


def test_second_order_convergence(spark):
    errors = []
    for n in (32, 64):
        f = from_function(spark, (n,), F.sin(2 * np.pi * F.col("i0") / n))
        got = to_array(evaluate("gradient(f)", {"f": f}, dx=1 / n, boundary="periodic"))
        errors.append(np.abs(np.ravel(got) - 2 * np.pi * np.cos(2 * np.pi * np.arange(n) / n)).max())
    assert 3.8 < errors[0] / errors[1] < 4.2


def test_one_exchange_for_all_axes(spark):
    f = from_function(spark, (20, 20, 20), F.col("i0") * 1.0)
    plan = evaluate("laplacian(f) + norm_last(gradient(f, boundary='periodic'))", {"f": f}, boundary="periodic").df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("bad", ["curl(f)", "divergence(f)", "jacobian(f)", "laplacian(gradient(f))", 'laplacian(f, boundary="round")', "surface_normals(f)", "moving_average(f, window=4)", "laplacian(3)"])
def test_kind_errors(spark, bad):
    with pytest.raises(ExpressionError):
        evaluate(bad, {"f": from_function(spark, (4, 4, 4), F.lit(1.0))})


def test_partial_sums_sort_nothing(spark):
    """Ordered frames meet in one exchange without a window; others of more kinds of taps, and later passes, go by blocks."""
    f = from_function(spark, (40, 30), F.col("i0") * 0.1 + F.col("i1"))
    plan = lambda e, **kw: evaluate(e, {"f": f}, **kw).df._jdf.queryExecution().executedPlan().toString()
    one = plan("laplacian(f) + norm_last(gradient(f)) + f")
    assert "Window" not in one and one.count("Exchange") == 1
    assert "Window" in plan("laplacian(laplacian(f))")


def test_a_cell_that_is_no_number_reaches_its_readers_only(spark):
    a = RNG.normal(size=(9, 8))
    a[4, 4] = np.nan
    got = to_array(evaluate("gradient(f)", {"f": to_field(spark, a)}))
    want = np.stack(np.gradient(a, edge_order=2), -1)
    assert np.allclose(got, want, equal_nan=True) and np.isfinite(got[4, 4, 0])
