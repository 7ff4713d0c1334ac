"""Box means of any width against plain sums over an index map, with short and forced long lines."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave import evaluate, from_function
from fieldweave.operators import lines
from grids import to_array, to_field

RNG = np.random.default_rng(9)
BOUNDARIES = ("periodic", "neumann", "dirichlet", "reflect")


def plain(a, window, boundary, axes=None):
    """Means by looking every cell of every window up."""
    for d in range(a.ndim) if axes is None else axes:
        n = a.shape[d]
        j = np.arange(n)[:, None] + np.arange(-(window // 2), window // 2 + 1)
        if boundary == "periodic":
            k = j % n
        elif boundary == "reflect":
            k = np.where(j < 0, np.minimum(-j, n - 1), np.where(j > n - 1, np.maximum(2 * (n - 1) - j, 0), j))
        else:
            k = np.clip(j, 0, n - 1)
        picked = np.take(a, k, axis=d)
        if boundary == "dirichlet":
            inside = ((j >= 0) & (j < n)).reshape([1] * d + list(j.shape) + [1] * (a.ndim - d - 1))
            picked = np.where(inside, picked, 0.0)
        a = picked.mean(axis=d + 1)
    return a


@pytest.mark.parametrize("boundary", BOUNDARIES)
@pytest.mark.parametrize("bound", [1 << 16, 8])
@pytest.mark.parametrize("window", [1, 3, 5, 7, 9, 13, 31, 101])
def test_windows(spark, monkeypatch, boundary, bound, window):
    """Windows shorter and longer than lines and than the bound on lines."""
    monkeypatch.setattr(lines, "LINE_CELLS", bound)
    a = RNG.normal(size=(29, 4) if window % 4 == 1 else (30,))
    got = to_array(evaluate(f'moving_average(f, window={window}, boundary="{boundary}")', {"f": to_field(spark, a)}))
    assert np.allclose(got, plain(a, window, boundary), atol=1e-12)


@pytest.mark.parametrize("boundary", BOUNDARIES)
def test_three_axes_beside_other_operators(spark, boundary):
    a = RNG.normal(size=(5, 4, 6))
    got = to_array(evaluate(f'moving_average(f, window=3, boundary="{boundary}") * 2 + f', {"f": to_field(spark, a)}))
    assert np.allclose(got, 2 * plain(a, 3, boundary) + a, atol=1e-12)


@pytest.mark.parametrize("boundary", BOUNDARIES)
def test_an_infinite_cell_reaches_its_windows_only(spark, boundary):
    a = RNG.normal(size=40)
    a[17] = np.inf
    got = to_array(evaluate(f'moving_average(f, window=7, boundary="{boundary}")', {"f": to_field(spark, a)}))
    assert np.isinf(got).sum() == 7 and np.isinf(got[14:21]).all() and not np.isnan(got).any()


def test_small_values_beside_large_ones(spark):
    """No large totals are taken from each other."""
    a = np.where(np.arange(60) < 30, 1e15, 1e-3)
    got = to_array(evaluate("moving_average(f, window=5)", {"f": to_field(spark, a)}))
    assert np.allclose(got[32:], 1e-3, rtol=1e-12)


def test_cost_does_not_depend_on_the_width(spark):
    f = from_function(spark, (300_000,), F.sin(F.col("i0") * 0.001))

    def seconds(window):
        began = time.time()
        evaluate(f"moving_average(f, window={window})", {"f": f}).df.agg(F.sum("v")).collect()
        return time.time() - began

    seconds(5)
    assert min(seconds(1001) for _ in range(2)) < 2.5 * min(seconds(5) for _ in range(2)) + 0.5
