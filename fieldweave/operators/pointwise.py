"""Pointwise arithmetic, functions and component plumbing: Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.registry import operator
from fieldweave.plans.expression import ExpressionError
from fieldweave.plans.workspace import Value

#: Smallest magnitude of a guarded denominator or logarithm.
EPS = 1e-15


def pair_up(op: str, a: Value, b: Value) -> list[tuple[Column, Column]]:
    """Components that meet: numbers and scalars meet every component, else kinds must agree."""
    for x, y in ((a, b), (b, a)):
        if x.kind == "number" or x.kind == "scalar" and y.kind in ("vector", "matrix"):
            pairs = [(x.column, c) for c in y.columns]
            return pairs if x is a else [(q, p) for p, q in pairs]
    if a.kind != b.kind or a.size != b.size:
        raise ExpressionError(f"{op} of a {a.kind} and a {b.kind}")
    return list(zip(a.columns, b.columns))


def _wider(a: Value, b: Value) -> Value:
    return max(a, b, key=lambda v: ("number", "pair", "scalar", "complex", "vector", "matrix").index(v.kind))


def _complex(op: str, *values: Value) -> None:
    if any(v.kind == "complex" for v in values):
        raise ExpressionError(f"{op} of complex values")


def _both(op: str, a: Value, b: Value, f) -> Value:
    like = _wider(a, b)
    if like.kind == "complex" and op in ("add", "sub") and {a.kind, b.kind} != {"complex"}:
        raise ExpressionError(f"{op} of complex and real values")
    return Value(like.kind, tuple(f(x, y) for x, y in pair_up(op, a, b)), like.size)


def _each(op: str, a: Value, f) -> Value:
    _complex(op, a)
    return Value(a.kind, tuple(f(c) for c in a.columns), a.size)


@operator("number")
def _number(ws, node):
    """A literal."""
    return Value("number", (F.lit(node.param("value")),))


@operator("field")
def _field(ws, node):
    """A declared field."""
    return ws.values[node.param("name")]


@operator("add")
def _add(ws, node, a, b):
    """a + b"""
    return _both("add", a, b, lambda x, y: x + y)


@operator("sub")
def _sub(ws, node, a, b):
    """a - b"""
    return _both("sub", a, b, lambda x, y: x - y)


@operator("mul")
def _mul(ws, node, a, b=None):
    """a * b, or a * scalar"""
    if b is None:
        if node.param("scalar") is None:
            raise ExpressionError("mul needs a second operand or scalar=")
        b = Value("number", (F.lit(float(node.param("scalar"))),))
    if a.kind == b.kind == "complex":
        (p, q), (r, s) = a.columns, b.columns
        return Value("complex", (p * r - q * s, p * s + q * r))
    if "complex" in (a.kind, b.kind) and "scalar" in (a.kind, b.kind):
        z, x = (a, b) if a.kind == "complex" else (b, a)
        return Value("complex", tuple(c * x.column for c in z.columns))
    return _both("mul", a, b, lambda x, y: x * y)


def guarded(b: Column, eps: float = EPS) -> Column:
    """A denominator kept away from zero, with its sign."""
    return F.when(F.abs(b) < eps, F.when(b < 0, -eps).otherwise(eps)).otherwise(b)


@operator("div")
def _div(ws, node, a, b):
    """a / b with denominators below eps replaced by eps of the same sign"""
    _complex("div", a, b)
    return _both("div", a, b, lambda x, y: x / guarded(y, node.param("eps", EPS)))


@operator("neg")
def _neg(ws, node, a):
    """-a"""
    return Value(a.kind, tuple(-c for c in a.columns), a.size)


@operator("clamp")
def _clamp(ws, node, a):
    """a limited to [lo, hi]; NaN stays"""
    lo, hi = float(node.param("lo", 0.0)), float(node.param("hi", 1.0))
    return _each("clamp", a, lambda c: F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi))))


@operator("exp", cost="medium")
def _exp(ws, node, a):
    """e to the power a"""
    return _each("exp", a, F.exp)


@operator("log", cost="medium")
def _log(ws, node, a):
    """natural logarithm of max(a, eps)"""
    return _each("log", a, lambda c: F.log(F.greatest(c, F.lit(float(node.param("eps", EPS))))))


@operator("sqrt")
def _sqrt(ws, node, a):
    """square root of max(a, eps)"""
    return _each("sqrt", a, lambda c: F.sqrt(F.greatest(c, F.lit(float(node.param("eps", 0.0))))))


@operator("sin", cost="medium")
def _sin(ws, node, a):
    """sine"""
    return _each("sin", a, F.sin)


@operator("cos", cost="medium")
def _cos(ws, node, a):
    """cosine"""
    return _each("cos", a, F.cos)


@operator("tanh", cost="medium")
def _tanh(ws, node, a):
    """hyperbolic tangent"""
    return _each("tanh", a, F.tanh)


@operator("ipow")
def _ipow(ws, node, a):
    """a multiplied by itself n times"""

    def raised(c):
        out = c
        for _ in range(node.param("n") - 1):
            out = out * c
        return out

    return _each("power", a, raised)


# Components ----------------------------------------------------------------------------------------------


def need(op: str, v: Value, kind: str) -> Value:
    if v.kind != kind:
        raise ExpressionError(f"{op} needs a {kind}, not a {v.kind}")
    return v


@operator("stack_components")
def _stack(ws, node, *parts):
    """scalar fields as a vector"""
    return Value("vector", tuple(need("stack_components", p, "scalar").column for p in parts), len(parts))


@operator("stack_matrix")
def _stack_matrix(ws, node, *parts):
    """scalar fields, row by row, as a square matrix"""
    size = math.isqrt(len(parts))
    if size * size != len(parts):
        raise ExpressionError("stack_matrix needs a square number of fields")
    return Value("matrix", tuple(need("stack_matrix", p, "scalar").column for p in parts), size)


@operator("select_component")
def _select(ws, node, v):
    """one component of a vector"""
    need("select_component", v, "vector")
    k = int(node.param("index", 0))
    if not -v.size <= k < v.size:
        raise ExpressionError(f"component {k} of {v.size}")
    return Value("scalar", (v.columns[k],))


def length(columns) -> Column:
    return F.sqrt(sum((c * c for c in columns), F.lit(0.0)))


@operator("norm_last")
def _norm_last(ws, node, v):
    """length of a vector, at least eps"""
    need("norm_last", v, "vector")
    return Value("scalar", (F.greatest(length(v.columns), F.lit(float(node.param("eps", EPS)))),))


def unguarded(a: Column, b: Column) -> Column:
    """Division as IEEE has it: by zero it gives an infinity of a's sign, or NaN."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


@operator("div_last")
def _div_last(ws, node, a, b):
    """components of a over the scalar b, with no guard"""
    need("div_last", a, "vector")
    return Value("vector", tuple(unguarded(c, b.column) for c in a.columns), a.size)


@operator("neg_stack3")
def _neg_stack3(ws, node, x, y):
    """unit vector of (-x, -y, 1)"""
    x, y = need("neg_stack3", x, "scalar").column, need("neg_stack3", y, "scalar").column
    long = F.greatest(F.sqrt(x * x + y * y + 1.0), F.lit(EPS))
    return Value("vector", (-x / long, -y / long, F.lit(1.0) / long), 3)


@operator("scale_eye")
def _scale_eye(ws, node, s):
    """a scalar times the unit matrix of size D"""
    need("scale_eye", s, "scalar")
    size = int(node.param("D", 3))
    return Value("matrix", tuple(s.column if r == c else F.lit(0.0) for r in range(size) for c in range(size)), size)


@operator("velocity_dot_grad")
def _velocity_dot_grad(ws, node, a, b):
    """product of a velocity component and a gradient component"""
    return _both("velocity_dot_grad", a, b, lambda x, y: x * y)
