"""Reductions to a number, or along one axis (``dim``), and integrals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldweave.functions.registry import operator
from fieldweave.operators.pointwise import need
from fieldweave.operators.stencil import BLOCK_CELLS
from fieldweave.plans.expression import ExpressionError
from fieldweave.plans.workspace import Reduced, Value, Workspace



def _elements(ws: Workspace, v: Value):
    """A frame with one row for each element of a field, as ``x``."""
    if v.is_number:
        raise ExpressionError("a reduction needs a field")
    if len(v.columns) == 1:
        return ws.df.select(*ws.keys, v.column.alias("x"))
    return ws.df.select(*ws.keys, F.explode(F.array(*v.columns)).alias("x"))


def _axis(ws: Workspace, dim: int) -> int:
    if not -ws.ndim <= dim < ws.ndim:
        raise ExpressionError(f"no axis {dim}")
    return dim % ws.ndim


def along(ws: Workspace, op: str, v: Value, aggregate, dim: int, keepdim: bool):
    """An aggregate of the lines along one axis: a smaller field, or with ``keepdim`` one value for all cells of a line."""
    c, d = need(op, v, "scalar").column, _axis(ws, dim)
    others = [a for a in ws.axes if a != f"i{d}"]
    if keepdim:
        if not others:
            return Value("scalar", ws.keep(ws.number(aggregate(c))))
        # Lines are aggregated before they meet the cells again.
        name = ws.fresh()
        lines = ws.df.groupBy(*others).agg(aggregate(c).alias(name))
        ws.df = ws.df.join(lines, others)
        return Value("scalar", (F.col(name),))
    if not others:
        return Value("number", (ws.number(aggregate(c)),))
    out = ws.df.groupBy(*others).agg(aggregate(c).alias("v"))
    renamed = [F.col(a).alias(f"i{k}") for k, a in enumerate(others)]
    return Reduced(out.select(*renamed, "v"), tuple(n for k, n in enumerate(ws.shape) if k != d))


def _reduce(ws: Workspace, node, v: Value, aggregate):
    dim = node.param("dim")
    if dim is not None:
        return along(ws, node.op, v, aggregate, dim, bool(node.param("keepdim", False)))
    return Value("number", (ws.number(aggregate(F.col("x")), _elements(ws, v)),))


@operator("sum", cost="medium")
def _sum(ws, node, v):
    """sum of all elements, or along dim"""
    return _reduce(ws, node, v, F.sum)


@operator("mean", cost="medium")
def _mean(ws, node, v):
    """mean of all elements, or along dim"""
    return _reduce(ws, node, v, F.avg)


@operator("norm_l2", cost="medium")
def _norm_l2(ws, node, v):
    """root of the sum of squares"""
    return Value("number", (ws.number(F.sqrt(F.sum(F.col("x") * F.col("x"))), _elements(ws, v)),))


@operator("min_max", cost="medium")
def _min_max(ws, node, v):
    """least and greatest element"""
    e = _elements(ws, v)
    return Value("pair", (ws.number(F.min("x"), e), ws.number(F.max("x"), e)))


@operator("variance", cost="medium")
def _variance(ws, node, v):
    """variance with n - 1, or with n if unbiased=False; of one element NaN, or 0"""
    if node.param("unbiased", True):
        return _reduce(ws, node, v, lambda c: F.coalesce(F.var_samp(c), F.lit(float("nan"))))
    return _reduce(ws, node, v, F.var_pop)


def _two(op: str, ws: Workspace, a: Value, b: Value):
    if a.is_number or b.is_number or a.kind != b.kind or a.size != b.size:
        raise ExpressionError(f"{op} needs two fields alike in shape")
    if len(a.columns) == 1:
        return ws.df.select(*ws.keys, a.column.alias("x"), b.column.alias("y"))
    pairs = F.explode(F.arrays_zip(F.array(*a.columns).alias("x"), F.array(*b.columns).alias("y")))
    return ws.df.select(*ws.keys, pairs.alias("p")).select(*ws.keys, "p.x", "p.y")


@operator("covariance", cost="medium")
def _covariance(ws, node, a, b):
    """covariance with max(n - 1, 1)"""
    return Value("number", (ws.number(F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)), _two("covariance", ws, a, b)),))


@operator("correlation", cost="medium")
def _correlation(ws, node, a, b):
    """correlation; 0 if either is constant"""
    n = F.count(F.lit(1)).cast("double")
    lengths = F.sqrt(n * F.var_pop("x")) * F.sqrt(n * F.var_pop("y")) + 1e-15
    return Value("number", (ws.number(n * F.covar_pop("x", "y") / lengths, _two("correlation", ws, a, b)),))


@operator("entropy", cost="medium")
def _entropy(ws, node, v):
    """Shannon entropy of |v| over its sum, of all elements or along dim"""
    eps, dim = float(node.param("eps", 1e-15)), node.param("dim")
    term = lambda p: -F.sum(p * F.log(p + eps))
    if dim is None:
        e = _elements(ws, v)
        total = e.agg(F.sum(F.abs("x")).alias("t")).scalar()
        return Value("number", (ws.number(term(F.abs("x") / (total + eps)), e),))
    total = along(ws, "entropy", Value("scalar", (F.abs(need("entropy", v, "scalar").column),)), F.sum, dim, True)
    return along(ws, "entropy", Value("scalar", (F.abs(v.column) / (total.column + eps),)), term, dim, bool(node.param("keepdim", False)))


@operator("surface_integral", cost="medium")
def _surface_integral(ws, node, t, normals, weights):
    """sum of (t . n) w"""
    need("surface_integral", t, "vector"), need("surface_integral", weights, "scalar")
    if normals.kind != "vector" or normals.size != t.size:
        raise ExpressionError("surface_integral needs normals like the field")
    dot = sum((a * b for a, b in zip(t.columns, normals.columns)), F.lit(0.0))
    return Value("number", (ws.number(F.sum(dot * weights.column)),))


# Integrals -----------------------------------------------------------------------------------------------


def quadrature(i: Column, n: int, h: float, method: str) -> Column:
    """A cell's weight along an axis: Simpson's rule (an even number of cells ends in a trapezoid), or the trapezoid rule."""
    if n == 1:
        return F.lit(0.0)
    if method != "simpson" or n < 3:
        return F.when((i == 0) | (i == n - 1), h / 2).otherwise(h)
    last = n - 1 if n % 2 else n - 2
    weight = F.when((i == 0) | (i == last), h / 3).when(i % 2 == 1, 4 * h / 3).otherwise(2 * h / 3)
    if n % 2:
        return weight
    return F.when(i == n - 1, F.lit(h / 2)).when(i == n - 2, F.lit(h / 3 + h / 2)).otherwise(weight)


@operator("integrate", cost="medium")
def _integrate(ws, node, v):
    """separable quadrature over dims (all by default), Simpson or trapezoid; dx is 1 unless given"""
    c = need("integrate", v, "scalar").column
    dx = node.param("dx", 1.0)
    dx = tuple(map(float, dx)) if isinstance(dx, tuple) else (float(dx),) * ws.ndim
    dims = node.param("dims")
    dims = range(ws.ndim) if dims is None else [dims] if isinstance(dims, int) else dims
    dims = {_axis(ws, d) for d in dims}
    weight = F.lit(1.0)
    for d in sorted(dims):
        weight = weight * quadrature(F.col(f"i{d}"), ws.shape[d], dx[d], node.param("method", "simpson"))
    others = [d for d in range(ws.ndim) if d not in dims]
    if not others:
        return Value("number", (ws.number(F.sum(c * weight)),))
    out = ws.df.groupBy(*[f"i{d}" for d in others]).agg(F.sum(c * weight).alias("v"))
    return Reduced(out.select(*[F.col(f"i{d}").alias(f"i{k}") for k, d in enumerate(others)], "v"), tuple(ws.shape[d] for d in others))


@operator("cumulative_integral")
def _cumulative(ws, node, v):
    """running trapezoid integral along dim, 0 at the start; dx is 1 unless given"""
    (c,) = ws.keep(need("cumulative_integral", v, "scalar").column)
    d, h = _axis(ws, node.param("dim", 0)), float(node.param("dx", 1.0))
    if ws.shape[d] < 2:
        return Value("scalar", (F.lit(0.0),))
    at, others = F.col(f"i{d}"), [a for a in ws.axes if a != f"i{d}"]
    # The integral is h * (sum to here - half of the first and of this cell). Sums run inside blocks of a line, whose
    # totals are added in a second, small running sum, so no line meets whole in one task.
    out, block = ws.fresh(), F.floor(at / BLOCK_CELLS).cast("int")
    df = ws.df.withColumn("_k", block)
    line = W.partitionBy(*others, "_k").orderBy(f"i{d}").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_run", F.sum(c).over(line))
    if ws.shape[d] > BLOCK_CELLS:
        totals = df.groupBy(*others, "_k").agg(F.sum(c).alias("_t"))
        before = W.partitionBy(*others).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
        totals = totals.select(*others, "_k", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_before"))
        df = df.join(totals, [*others, "_k"]).withColumn("_run", F.col("_run") + F.col("_before")).drop("_before")
    if others:
        first = ws.df.where(at == 0).select(*others, c.alias("_first"))
        df = df.join(first, others)
    else:
        df = df.withColumn("_first", ws.df.where(at == 0).select(c.alias("x")).scalar())
    df = df.withColumn(out, F.when(at == 0, F.lit(0.0)).otherwise((F.col("_run") - (F.col("_first") + c) / 2) * F.lit(h)))
    ws.df = df.drop("_k", "_run", "_first")
    return Value("scalar", (F.col(out),))
