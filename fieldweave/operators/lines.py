"""Operators that need a whole line of cells at once: Fourier transforms and the distance transform.

Cells are gathered by their other coordinates and come to NumPy as boxes of one axis, or of several short ones together, many boxes at a
time. A long line meets in no task. For Fourier transforms its axis is laid out as two, and those again while they are long; a length without
factors becomes a convolution of a length that has them (a chirp). Distances along it are found by blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldweave.functions.registry import operator
from fieldweave.operators.pointwise import need
from fieldweave.plans.expression import ExpressionError
from fieldweave.plans.workspace import Value, Workspace

#: Cells of a line, or of a box, that one task may hold as a row.
LINE_CELLS = 1 << 16
#: Cells that are worked on at once.
CELLS_AT_ONCE = 1 << 20
_bound: ContextVar[int | None] = ContextVar("line_cells", default=None)


def line_cells() -> int:
    """The bound on lines of the plans built now."""
    return _bound.get() or LINE_CELLS


@contextmanager
def bounded_lines(cells: int) -> Iterator[None]:
    """Plans built inside keep no more cells of a line in a row; results are the same."""
    token = _bound.set(cells)
    try:
        yield
    finally:
        _bound.reset(token)


def boxes(df: DataFrame, shape: tuple[int, ...], axes: tuple[int, ...], columns: list[str]) -> DataFrame:
    """Cells gathered over ``axes``: the other coordinates, and a list of places within the box and values, in any order."""
    place = reduce(lambda k, d: k * shape[d] + F.col(f"i{d}"), axes, F.lit(0)).cast("int")
    others = [f"i{d}" for d in range(len(shape)) if d not in axes]
    return df.groupBy(*others).agg(F.collect_list(F.struct(place.alias("i"), *[F.col(c) for c in columns])).alias("line"))


def unpacked(lists: pa.Array, cells: int, columns: list[str], missing: float = 0.0) -> list[np.ndarray]:
    """Arrays (box, cell) of the columns of such lists."""
    line, offsets = lists.flatten(), np.asarray(lists.offsets)
    at = np.repeat(np.arange(len(lists)) * cells, np.diff(offsets)) + line.field("i").to_numpy()
    out = []
    for c in columns:
        whole = np.full(len(lists) * cells, missing)
        whole[at] = line.field(c).to_numpy(zero_copy_only=False)
        out.append(whole.reshape(len(lists), cells))
    return out


def along(df: DataFrame, shape: tuple[int, ...], axes: tuple[int, ...], columns: list[str], f, results: list[str]) -> DataFrame:
    """``f`` takes each column as an array (boxes, cells along each of the axes) and gives the results likewise. Cells that are not there are 0."""
    dims, others = tuple(shape[d] for d in axes), [d for d in range(len(shape)) if d not in axes]
    cells = math.prod(dims)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, max(1, CELLS_AT_ONCE // cells)):
                batch = whole.slice(k, max(1, CELLS_AT_ONCE // cells))
                out = f(*[x.reshape(-1, *dims) for x in unpacked(batch.column(len(others)), cells, columns)])
                at = {d: np.repeat(batch.column(j).to_numpy(), cells) for j, d in enumerate(others)}
                at |= {d: np.tile(x.ravel().astype(np.int32), batch.num_rows) for d, x in zip(axes, np.indices(dims))}
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(at[d], pa.int32()) for d in range(len(shape))), *(pa.array(np.ascontiguousarray(o, float).ravel(), pa.float64()) for o in out)],
                    names=[*(f"i{d}" for d in range(len(shape))), *results],
                )

    schema = ", ".join([f"i{d} int" for d in range(len(shape))] + [f"{r} double" for r in results])
    return boxes(df, shape, axes, columns).mapInArrow(run, schema)


def grouped(shape: tuple[int, ...], axes) -> list[tuple[int, ...]]:
    """The axes, those that fit into one box together; an axis beyond the bound is alone."""
    out: list[tuple[int, ...]] = []
    for d in axes:
        if out and math.prod(shape[e] for e in out[-1]) * shape[d] <= line_cells():
            out[-1] = (*out[-1], d)
        else:
            out.append((d,))
    return out


def adopt(ws: Workspace, node, out: DataFrame, names: list[str]) -> tuple:
    """Bring a result into the frame by its coordinates; where it is all that is asked for, it becomes the frame."""
    fresh = [ws.fresh() for _ in names]
    new = out.select(*ws.axes, *[F.col(n).alias(x) for n, x in zip(names, fresh)])
    ws.df = new if ws.only == node else ws.df.join(new, ws.axes)
    return tuple(F.col(x) for x in fresh)


def _parts(ws: Workspace, node, v: Value) -> DataFrame:
    if v.kind == "complex":
        re, im = v.columns
    else:
        re, im = need(node.op, v, "scalar").column, F.lit(0.0)
    return ws.df.select(*ws.axes, re.alias("re"), im.alias("im"))


def _transform(ws: Workspace, node, v: Value, sign: int) -> DataFrame:
    norm = {"numpy_compatible": "backward"}.get(node.param("norm", "backward"), node.param("norm", "backward"))
    if norm not in ("backward", "ortho", "forward"):
        raise ExpressionError(f"unknown norm {norm!r}")
    return fourier(_parts(ws, node, v), ws.shape, range(ws.ndim), sign, norm)


def factors(n: int) -> tuple[int, int]:
    """The factors of n nearest to its root."""
    a = math.isqrt(n)
    while n % a:
        a -= 1
    return a, n // a


def fourier(df: DataFrame, shape: tuple[int, ...], axes, sign: int, norm: str = "backward") -> DataFrame:
    """Transforms of re and im along axes (sign -1, or 1 for inverse ones)."""
    one = np.fft.fftn if sign < 0 else np.fft.ifftn

    def f(re, im):
        z = one(re + 1j * im, axes=range(1, re.ndim), norm=norm)
        return z.real, z.imag

    for box in grouped(shape, axes):
        n = math.prod(shape[d] for d in box)
        if n <= line_cells():
            df = along(df, shape, box, ["re", "im"], f, ["re", "im"])
        elif factors(n)[0] > 1:
            df = _laid_out(df, shape, box[0], sign, norm)
        else:
            df = _chirp(df, shape, box[0], sign, norm)
    return df


def _turned(df: DataFrame, at: list, angle: Column, scale: float = 1.0) -> DataFrame:
    """re and im times scale and exp(i angle)."""
    re, im, cos, sin = F.col("re"), F.col("im"), F.cos(angle) * scale, F.sin(angle) * scale
    return df.select(*at, (re * cos - im * sin).alias("re"), (re * sin + im * cos).alias("im"))


def _laid_out(df: DataFrame, shape: tuple[int, ...], d: int, sign: int, norm: str) -> DataFrame:
    """A long axis of n1 * n2 cells as two: transforms over n1 cells n2 apart, a turn of each result by its place, and transforms over n2 cells give those of the whole line."""
    n, last = shape[d], len(shape)
    n1, n2 = factors(n)
    i, both = f"i{d}", (*shape[:d], n1, *shape[d + 1 :], n2)
    df = df.withColumn(f"i{last}", F.pmod(F.col(i), F.lit(n2))).withColumn(i, F.floor(F.col(i) / n2).cast("int"))
    df = fourier(df, both, [d], sign, norm)
    turn = F.lit(sign * 2 * math.pi / n) * F.pmod(F.col(i).cast("long") * F.col(f"i{last}"), F.lit(n))
    df = fourier(_turned(df, [f"i{e}" for e in range(last + 1)], turn), both, [last], sign, norm)
    place = (F.col(i) + F.col(f"i{last}") * n1).cast("int").alias(i)
    return df.select(*[place if e == d else f"i{e}" for e in range(last)], "re", "im")


def _chirp(df: DataFrame, shape: tuple[int, ...], d: int, sign: int, norm: str) -> DataFrame:
    """A long axis of a prime number n of cells: as 2jk = j*j + k*k - (k-j)*(k-j), its transform is a convolution with a chirp, done by transforms of a power of two of cells."""
    n, m = shape[d], 1 << (2 * shape[d] - 2).bit_length()
    i, at, wide = F.col(f"i{d}").cast("long"), [f"i{e}" for e in range(len(shape))], (*shape[:d], m, *shape[d + 1 :])
    turn = lambda k, s: F.lit(s * math.pi / n) * F.pmod(k * k, F.lit(2 * n))
    lines = fourier(_turned(df, at, turn(i, sign)), wide, [d], -1)
    k = F.least(F.col("id"), F.lit(m) - F.col("id"))
    chirp = df.sparkSession.range(m).where(k < n).select(F.col("id").cast("int").alias("i0"), F.cos(turn(k, -sign)).alias("re"), F.sin(turn(k, -sign)).alias("im"))
    chirp = fourier(chirp, (m,), [0], -1).select(F.col("i0").alias(f"i{d}"), F.col("re").alias("c"), F.col("im").alias("s"))
    re, im, c, s = (F.col(x) for x in ("re", "im", "c", "s"))
    product = lines.join(chirp, f"i{d}").select(*at, (re * c - im * s).alias("re"), (re * s + im * c).alias("im"))
    scale = {"backward": 0.0 if sign < 0 else -1.0, "ortho": -0.5, "forward": -1.0 if sign < 0 else 0.0}[norm]
    return _turned(fourier(product, wide, [d], 1).where(F.col(f"i{d}") < n), at, turn(i, sign), float(n) ** scale)


def _derived(shape: tuple[int, ...], box: tuple[int, ...], steps: tuple[float, ...], second: bool):
    """A function of boxes: the sum of the first or second derivatives along their axes, by a transform, the axis's wave numbers, and the transform back."""

    def f(x):
        out = np.zeros(x.shape)
        for a, d in enumerate(box, 1):
            k = (2 * math.pi * np.fft.fftfreq(shape[d], steps[d])).reshape([-1 if e == a else 1 for e in range(x.ndim)])
            out += np.fft.ifft((-(k**2) if second else 1j * k) * np.fft.fft(x, axis=a), axis=a).real
        return [out]

    return f


def spectral(df: DataFrame, shape: tuple[int, ...], axes, steps: tuple[float, ...], second: bool) -> DataFrame:
    """The sum of the first or second derivatives of ``v`` along axes."""
    parts = []
    for box in grouped(shape, axes):
        d, at = box[0], [f"i{e}" for e in range(len(shape))]
        if math.prod(shape[e] for e in box) <= line_cells():
            parts.append(along(df, shape, box, ["v"], _derived(shape, box, steps, second), ["v"]))
            continue
        n, i, re, im = shape[d], F.col(f"i{d}"), F.col("re"), F.col("im")
        whole = fourier(df.select(*at, F.col("v").alias("re"), F.lit(0.0).alias("im")), shape, [d], -1)
        k = F.lit(2 * math.pi / (n * steps[d])) * F.when(i <= (n - 1) // 2, i).otherwise(i - n)
        turned = whole.select(*at, (-k * k * re if second else -k * im).alias("re"), (-k * k * im if second else k * re).alias("im"))
        parts.append(fourier(turned, shape, [d], 1).select(*at, F.col("re").alias("v")))
    if len(parts) == 1:
        return parts[0]
    # Each box's part is a partial sum of the cells' results.
    return reduce(DataFrame.unionByName, parts).groupBy(*[f"i{e}" for e in range(len(shape))]).agg(F.sum("v").alias("v"))


@operator("fft", cost="high")
def _fft(ws, node, v):
    """N-D Fourier transform, complex"""
    return Value("complex", adopt(ws, node, _transform(ws, node, v, -1), ["re", "im"]))


@operator("fft_complex", cost="high")
def _fft_complex(ws, node, v):
    """as fft"""
    return _fft(ws, node, v)


@operator("ifft", cost="high")
def _ifft(ws, node, v):
    """real part of the inverse transform"""
    return Value("scalar", adopt(ws, node, _transform(ws, node, v, 1), ["re"]))


@operator("ifft_complex", cost="high")
def _ifft_complex(ws, node, v):
    """inverse transform, complex"""
    return Value("complex", adopt(ws, node, _transform(ws, node, v, 1), ["re", "im"]))


def _steps(node, ndim: int) -> tuple[float, ...]:
    dx = node.param("dx", 1.0)
    return tuple(map(float, dx)) if isinstance(dx, tuple) else (float(dx),) * ndim


@operator("spectral_gradient", cost="high")
def _spectral_gradient(ws, node, v):
    """derivative along dim by Fourier transforms of the lines of that axis alone; dx is 1 unless given"""
    df = ws.df.select(*ws.axes, need("spectral_gradient", v, "scalar").column.alias("v"))
    return Value("scalar", adopt(ws, node, spectral(df, ws.shape, [node.param("dim", 0) % ws.ndim], _steps(node, ws.ndim), False), ["v"]))


@operator("spectral_laplacian", cost="high")
def _spectral_laplacian(ws, node, v):
    """sum of second derivatives, each by transforms of one axis's lines; dx is 1 unless given"""
    df = ws.df.select(*ws.axes, need("spectral_laplacian", v, "scalar").column.alias("v"))
    return Value("scalar", adopt(ws, node, spectral(df, ws.shape, range(ws.ndim), _steps(node, ws.ndim), True), ["v"]))


def nearest_squares(f: np.ndarray, h: float, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each position q in ``at`` (rising; else every cell) and each line, the least of f[p] + (h (q - p))**2 over the line, and its first p; infinite on lines without a finite cell.

    The p that gives the least never falls as q grows. So the positions are taken in rounds, each between positions of earlier rounds,
    and look only at what lies between their neighbours' p: a round passes over a line once, and rounds are as many as their number has bits.
    """
    n, at = f.shape[1], np.arange(f.shape[1]) if at is None else at
    m = len(at)
    out, first = np.full((len(f), m), np.inf), np.zeros((len(f), m), np.int64)
    some = np.flatnonzero(np.isfinite(f).any(1))
    for begin in range(0, len(some), max(1, CELLS_AT_ONCE // max(n, m))):
        rows = some[begin : begin + max(1, CELLS_AT_ONCE // max(n, m))]
        g, best = f[rows], np.zeros((len(rows), m), np.int64)
        step = 1 << m.bit_length()
        while step:
            q = np.arange(step - 1, m, 2 * step)
            if len(q):
                low = np.where(q - step >= 0, best[:, np.maximum(q - step, 0)], 0).ravel()
                high = np.where(q + step < m, best[:, np.minimum(q + step, m - 1)], n - 1).ravel()
                sizes = high - low + 1
                starts = np.cumsum(sizes) - sizes
                of = np.repeat(np.arange(len(sizes)), sizes)
                p = np.arange(len(of)) - starts[of] + low[of]
                value = g[of // len(q), p] + (h * (at[q][of % len(q)] - p)) ** 2
                least = np.minimum.reduceat(value, starts)
                hit = np.flatnonzero(value == least[of])[::-1]
                found = np.empty(len(sizes), np.int64)
                found[of[hit]] = p[hit]
                best[:, q] = found.reshape(len(rows), -1)
                out[rows[:, None], q] = least.reshape(len(rows), -1)
            step //= 2
        first[rows] = best
    return out, first


def _nearest_in_boxes(steps: list[float]):
    """A function of boxes: the least of v and squared distance along each axis in turn."""

    def f(x):
        for a, h in enumerate(steps, 1):
            moved = np.moveaxis(x, a, -1)
            least, _ = nearest_squares(np.ascontiguousarray(moved).reshape(-1, moved.shape[-1]), h)
            x = np.moveaxis(least.reshape(moved.shape), -1, a)
        return [x]

    return f


def nearest_across_blocks(df: DataFrame, shape: tuple[int, ...], d: int, h: float) -> DataFrame:
    """As ``nearest_squares``, for v along a long axis.

    Every block of the line gives its least for the first cell of each block, so these cells' nearest p are known. A block's own cells find theirs between
    that of its first cell and that of the next block's: it meets the blocks of that stretch alone, one at a time. Stretches of neighbours share no
    more than an end, so a line of k blocks has fewer than 2 k such meetings, wherever its finite cells lie.
    """
    n, block = shape[d], line_cells()
    i, others, at = F.col(f"i{d}"), [f"i{e}" for e in range(len(shape)) if e != d], [f"i{e}" for e in range(len(shape))]
    count = -(-n // block)
    ends = np.minimum(np.arange(count + 1, dtype=np.int64) * block, n - 1)
    cut = df.where(F.col("v") < float("inf")).select(*others, F.floor(i / block).cast("int").alias("_b"), F.pmod(i, F.lit(block)).cast("int").alias("i"), "v")
    held = cut.groupBy(*others, "_b").agg(F.collect_list(F.struct("i", "v")).alias("line"))
    keys = ", ".join(f"{c} int" for c in others) + ", " * bool(others)

    def at_ends(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                start = row.column(len(others)).to_numpy()[0] * block
                least, first = nearest_squares(unpacked(row.column(len(others) + 1), block, ["v"], np.inf)[0], h, ends - start)
                own = [pa.array(np.repeat(row.column(j).to_numpy(), count + 1), pa.int32()) for j in range(len(others))]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.arange(count + 1), pa.int32()), pa.array(least[0]), pa.array(first[0] + start, pa.int64())], names=[*others, "k", "least", "p"]
                )

    coarse = held.mapInArrow(at_ends, keys + "k int, least double, p long").groupBy(*others, "k").agg(F.min(F.struct("least", "p")).getField("p").alias("p"))
    after = F.lead("p").over(W.partitionBy(*others).orderBy("k"))
    ranges = coarse.select(*others, "k", "p", after.alias("to")).where(F.col("to").isNotNull())
    met = ranges.select("*", F.explode(F.sequence(*[F.floor(F.col(c) / block).cast("int") for c in ("p", "to")])).alias("_b"))
    pairs = met.join(held, [*others, "_b"]).select(*others, "_b", "k", "p", "to", "line")

    def between(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                b, k, low, high = (int(row.column(len(others) + j).to_numpy()[0]) for j in range(4))
                start, mine = b * block, np.arange(k * block, min((k + 1) * block, n))
                first, last = max(low - start, 0), min(high - start, block - 1)
                f = unpacked(row.column(len(others) + 4), block, ["v"], np.inf)[0][:, first : last + 1]
                least, _ = nearest_squares(f, h, mine - start - first)
                own = {c: pa.array(np.repeat(row.column(j).to_numpy(), len(mine)), pa.int32()) for j, c in enumerate(others)} | {f"i{d}": pa.array(mine, pa.int32())}
                yield pa.RecordBatch.from_arrays([*(own[c] for c in at), pa.array(least[0])], names=[*at, "v"])

    found = pairs.mapInArrow(between, ", ".join(f"{c} int" for c in at) + ", v double")
    return df.select(*at, "v").unionByName(found).groupBy(*at).agg(F.min("v").alias("v"))


def nearest_by_blocks(df: DataFrame, shape: tuple[int, ...], d: int, h: float) -> DataFrame:
    """Squared distances along a long axis from cells whose v is 0, of a field of zeros and infinities: within blocks, and to what the blocks before and after carry."""
    i, others = f"i{d}", [f"i{e}" for e in range(len(shape)) if e != d]
    cells = df.withColumn("_b", F.floor(F.col(i) / line_cells())).withColumn("_t", F.when(F.col("v") == 0.0, F.col(i)))
    # Running frames in either order: what follows a row is what precedes it backwards.
    running = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = lambda order: W.partitionBy(*others).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ends = cells.groupBy(*others, "_b").agg(F.min("_t").alias("first"), F.max("_t").alias("last"))
    carried = ends.select(
        *others,
        "_b",
        F.last("last", ignorenulls=True).over(earlier(F.asc("_b"))).alias("_before"),
        F.last("first", ignorenulls=True).over(earlier(F.desc("_b"))).alias("_after"),
    )
    block = [*others, "_b"]
    before = F.coalesce(F.last("_t", ignorenulls=True).over(running(block, F.asc(i))), F.col("_before"))
    after = F.coalesce(F.last("_t", ignorenulls=True).over(running(block, F.desc(i))), F.col("_after"))
    near = F.least(F.col(i) - before, after - F.col(i)).cast("double") * F.lit(h)
    at = [f"i{e}" for e in range(len(shape))]
    return cells.join(carried, [*others, "_b"]).select(*at, F.coalesce(near * near, F.lit(float("inf"))).alias("v"))


@operator("distance_transform", cost="very_high")
def _distance_transform(ws, node, v):
    """exact Euclidean distance of zero cells to the nearest other cell, 0 elsewhere; null if every cell is zero"""
    if node.param("method", "auto") not in ("auto", "fast"):
        raise ExpressionError("method is auto or fast")
    dx = _steps(node, ws.ndim)
    c = need("distance_transform", v, "scalar").column
    df = ws.df.select(*ws.axes, F.when(c == 0, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("v"))
    # The longest axis comes first: at the beginning the values are zeros and infinities.
    for k, box in enumerate(grouped(ws.shape, sorted(range(ws.ndim), key=lambda d: -ws.shape[d]))):
        d = box[0]
        if math.prod(ws.shape[e] for e in box) <= line_cells():
            df = along(df, ws.shape, box, ["v"], _nearest_in_boxes([dx[e] for e in box]), ["v"])
        else:
            df = (nearest_across_blocks if k else nearest_by_blocks)(df, ws.shape, d, dx[d])
    far = F.col("v") == float("inf")
    return Value("scalar", adopt(ws, node, df.withColumn("v", F.when(~far, F.sqrt("v"))), ["v"]))
