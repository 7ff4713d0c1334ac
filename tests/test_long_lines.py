"""Line transforms of long lines, which meet in no task, against NumPy and plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave import evaluate, from_function
from fieldweave.field import Field
from fieldweave.operators import lines


def _field(spark, values):
    at = [f"i{d}" for d in range(values.ndim)]
    index = np.indices(values.shape).reshape(values.ndim, -1)
    rows = [(*map(int, c), float(v)) for *c, v in zip(*index, values.ravel())]
    return Field(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in at) + ", v double"), values.shape)


def _array(result, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in result.df.collect():
        out[tuple(r[f"i{d}"] for d in range(len(shape)))] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize("shape", [(60,), (1, 63), (5, 36), (37,), (3, 29), (720,), (74,), (13, 17)])
def test_split_lines(spark, monkeypatch, shape):
    """Axes laid out as two give what whole lines give; 37 has no factors and is convolved with a chirp."""
    monkeypatch.setattr(lines, "LINE_CELLS", 12)
    v = np.random.default_rng(1).normal(size=shape)
    f = {"f": _field(spark, v)}
    for norm in ("backward", "ortho", "forward"):
        got = evaluate(f'fft(f, norm="{norm}")', f)
        want = np.fft.fftn(v, norm=norm)
        assert np.allclose(_array(got, shape, "re"), want.real) and np.allclose(_array(got, shape, "im"), want.imag)
    assert np.allclose(_array(evaluate("ifft(fft(f))", f), shape), v)
    d = len(shape) - 1
    k = 2 * np.pi * np.fft.fftfreq(shape[d], 0.5).reshape([-1 if e == d else 1 for e in range(len(shape))])
    want = np.fft.ifft(1j * k * np.fft.fft(v, axis=d), axis=d).real
    assert np.allclose(_array(evaluate(f"spectral_gradient(f, dim={d}, dx=0.5)", f), shape), want)


@pytest.mark.parametrize("shape", [(50,), (40, 3), (2, 50)])
@pytest.mark.parametrize("share", [0.05, 0.5, 0.0])
def test_distances(spark, monkeypatch, shape, share):
    monkeypatch.setattr(lines, "LINE_CELLS", 8)
    v = (np.random.default_rng(2).random(shape) < share).astype(float)
    got = _array(evaluate("distance_transform(f, dx=0.5)", {"f": _field(spark, v)}), shape)
    targets, cells = np.argwhere(v != 0), np.indices(shape).reshape(len(shape), -1).T
    if not len(targets):
        assert np.isnan(got).all()
    else:
        want = 0.5 * np.sqrt(((cells[:, None] - targets[None]) ** 2).sum(2).min(1)).reshape(shape)
        assert np.allclose(got, want)


def test_nearest_squares_against_all_pairs():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 101):
        f = np.where(r.random((40, n)) < 0.5, r.random((40, n)) * 50, np.inf)
        f[0] = np.inf
        q = np.arange(n)
        want = (f[:, None, :] + (0.7 * (q[:, None] - q[None, :])) ** 2).min(2)
        assert np.allclose(lines.nearest_squares(f, 0.7)[0], want)


def test_nearest_squares_at_other_positions():
    r = np.random.default_rng(4)
    f = np.where(r.random((20, 31)) < 0.5, r.random((20, 31)) * 50, np.inf)
    for at in (np.array([-40, -3, 0, 7, 30, 31, 90]), np.arange(5, 12), np.array([100])):
        value = f[:, None, :] + (0.7 * (at[:, None] - np.arange(31)[None, :])) ** 2
        least, first = lines.nearest_squares(f, 0.7, at)
        assert np.allclose(least, value.min(2)) and (first[np.isfinite(f).any(1)] == value.argmin(2)[np.isfinite(f).any(1)]).all()


def rows_are_bounded(result, cells):
    """No list that a plan gathers holds more cells than the bound: axes of every gathered box are known from the plan."""
    sizes = []
    real = lines.boxes

    def spy(df, shape, axes, columns):
        sizes.append(int(np.prod([shape[d] for d in axes])))
        return real(df, shape, axes, columns)

    lines.boxes = spy
    try:
        out = result()
    finally:
        lines.boxes = real
    assert sizes and max(sizes) <= cells
    return out


@pytest.mark.parametrize("n", [10_007, 10_006, 3 * 10_007])
def test_a_long_line_without_factors(spark, n):
    """A prime length, twice and thrice one: convolved with a chirp, in rows of at most 256 cells."""
    v = np.random.default_rng(6).normal(size=n)
    rows = spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(v)], "i0 int, v double")
    f = {"f": Field(rows, (n,))}
    with lines.bounded_lines(256):
        got = rows_are_bounded(lambda: evaluate("fft(f)", f), 256)
        back = rows_are_bounded(lambda: evaluate('ifft(fft(f, norm="ortho"), norm="ortho")', f), 256)
    want = np.fft.fft(v)
    assert np.allclose(_array(got, (n,), "re"), want.real, atol=1e-8) and np.allclose(_array(got, (n,), "im"), want.imag, atol=1e-8)
    assert np.allclose(_array(back, (n,)), v, atol=1e-9)


def test_a_prime_length_of_a_million(spark):
    n = 1_000_003
    i = F.col("i0").cast("long")
    waves = from_function(spark, (n,), F.cos(F.pmod(i * 3, F.lit(n)) * (2 * np.pi / n)) + 2 * F.sin(F.pmod(i * 70_001, F.lit(n)) * (2 * np.pi / n)))
    result = rows_are_bounded(lambda: evaluate("fft(f)", {"f": waves}), 1 << 16)
    big = {r.i0: (r.re, r.im) for r in result.df.where("abs(re) + abs(im) > 1").collect()}
    assert set(big) == {3, n - 3, 70_001, n - 70_001}
    assert big[3] == pytest.approx((n / 2, 0), abs=1) and big[70_001] == pytest.approx((0, -n), abs=1)


@pytest.mark.parametrize("shape", [(70, 60), (33, 41, 5)])
@pytest.mark.parametrize("marks", [1, 6, 0])
def test_two_long_axes(spark, shape, marks):
    """A sparse mask whose axes all pass the bound: cells far from every mark find theirs across many blocks."""
    r = np.random.default_rng(marks)
    v = np.zeros(shape)
    for _ in range(marks):
        v[tuple(int(r.integers(0, n)) for n in shape)] = 1.0
    with lines.bounded_lines(4):
        result = evaluate("distance_transform(f, dx=0.25)", {"f": _field(spark, v)})
    got, targets, cells = _array(result, shape), np.argwhere(v != 0), np.indices(shape).reshape(len(shape), -1).T
    if not marks:
        assert np.isnan(got).all()
    else:
        assert np.allclose(got, 0.25 * np.sqrt(((cells[:, None] - targets[None]) ** 2).sum(2).min(1)).reshape(shape))


def test_a_line_of_a_million_cells(spark):
    """Against closed forms: the transform of two waves, and distances from cells that stand far apart."""
    n = 1_000_000
    i = F.col("i0")
    waves = from_function(spark, (n,), F.cos(i * (2 * np.pi * 3 / n)) + 2 * F.sin(i * (2 * np.pi * 70_001 / n)))
    big = {r.i0: (r.re, r.im) for r in evaluate("fft(f)", {"f": waves}).df.where("abs(re) + abs(im) > 1").collect()}
    assert set(big) == {3, n - 3, 70_001, n - 70_001}
    assert big[3] == pytest.approx((n / 2, 0), abs=1) and big[70_001] == pytest.approx((0, -n), abs=1)
    marks = from_function(spark, (n,), F.when(i.isin(5, 400_000), 1.0).otherwise(0.0))
    row = evaluate("distance_transform(f)", {"f": marks}).df.agg(F.sum("v").alias("s"), F.max("v").alias("m"), F.count("v").alias("n")).first()
    at = np.arange(n)
    want = np.minimum(abs(at - 5), abs(at - 400_000))
    assert (row.s, row.m, row.n) == (float(want.sum()), float(want.max()), n)
