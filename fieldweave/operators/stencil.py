"""Stencil operators: neighbour taps with four boundary rules, many operators in one exchange.

Cells are dealt to blocks of the grid; cells near a block's faces are also sent, as ghosts that hold only the tapped columns, to the
neighbour (with periodic axes, around the ends). After that single exchange every tap is a lag or lead
within a line of a block, and the windows of all axes reuse the exchange. A block is bounded, so neither
long lines nor large grids meet in one task. Where cells come in order of their axes, linear stencils are sums of what cells send to those that read them (``taps``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldweave.functions.registry import register_operator
from fieldweave.operators import taps
from fieldweave.operators.taps import NeedsWindows, Recorder, add_up, shares
from fieldweave.plans.expression import ExpressionError, Node, call
from fieldweave.plans.workspace import Value, Workspace

BOUNDARIES = ("periodic", "neumann", "dirichlet", "reflect")
#: Cells a block should hold.
BLOCK_CELLS = 1 << 15


@dataclass(frozen=True)
class StencilPlan:
    """How far an operator reads, along which axes, and its result from taps: ``combine(tap)`` with ``tap(column, axis, offset)``."""

    reach: int
    axes: tuple[int, ...]
    combine: Callable
    kind: str = "scalar"
    size: int = 1


def blocks_per_axis(shape: tuple[int, ...], reach: int) -> list[int]:
    side = max(2 * reach, round(BLOCK_CELLS ** (1 / len(shape))), 1)
    return [max(1, n // side) for n in shape]


def with_halo(df: DataFrame, shape: tuple[int, ...], axes: tuple[int, ...], reach: int, periodic: bool, tapped: set[str]) -> DataFrame:
    """The cells and their ghosts: ``_b`` (block), ``_own``, and coordinates ``_g0..`` that go on past the ends where an axis wraps. Ghosts hold the ``tapped`` columns only."""
    per_axis = blocks_per_axis(shape, reach)
    home = [F.col(f"i{d}") for d in range(len(shape))]
    block = [F.floor(i.cast("long") * nb / n).cast("int") if nb > 1 else F.lit(0) for i, n, nb in zip(home, shape, per_axis)]
    #: Of each kind of ghost: whether a cell has it, its axis, and how far its block and its coordinate are moved.
    ghosts: list[tuple[Column, int, int, int]] = []
    for d in axes:
        n, nb, i, b = shape[d], per_axis[d], home[d], block[d]
        if nb == 1:
            for k in range(1, -(-reach // n) + 1) if periodic else ():
                ghosts += [(i + k * n < n + reach, d, 0, k * n), (i - k * n >= -reach, d, 0, -k * n)]
            continue
        low, high = i - F.ceil(b * n / nb) < reach, F.ceil((b + 1) * n / nb) - 1 - i < reach
        ghosts += [(low & (b > 0), d, -1, 0), (high & (b < nb - 1), d, 1, 0)]
        if periodic:
            ghosts += [(low & (b == 0), d, nb - 1, n), (high & (b == nb - 1), d, 1 - nb, -n)]
    spread = df.select("*", *[b.alias(f"_b{d}") for d, b in enumerate(block)])
    code = F.lit(0)
    if ghosts:
        # Only cells near a face list the kinds of their ghosts; each kind's number is the same for all cells.
        kinds = F.array_compact(F.array(F.lit(0), *[F.when(has, F.lit(k + 1)) for k, (has, *_) in enumerate(ghosts)]))
        near = reduce(lambda x, y: x | y, [has for has, *_ in ghosts])
        spread = spread.select("*", F.explode(F.when(near, kinds).otherwise(F.array(F.lit(0)))).alias("_k"))
        code = F.col("_k")

    def moved(base: Column, d: int, part: int) -> Column:
        out = base
        for k, g in enumerate(ghosts):
            if g[1] == d and g[part]:
                out = F.when(code == k + 1, base + g[part]).otherwise(out)
        return out

    key = F.lit(0).cast("long")
    for d, nb in enumerate(per_axis):
        key = key * nb + moved(F.col(f"_b{d}"), d, 2)
    own = code == 0
    columns = [F.col(c) if c in tapped or not ghosts else F.when(own, F.col(c)).alias(c) for c in df.columns]
    return spread.select(*columns, key.alias("_b"), own.alias("_own"), *[moved(i, d, 3).cast("int").alias(f"_g{d}") for d, i in enumerate(home)]).repartition("_b")


def known(boundary: str) -> str:
    if boundary not in BOUNDARIES:
        raise ExpressionError(f"unknown boundary {boundary!r}; known are {BOUNDARIES}")
    return boundary


def tapper(shape: tuple[int, ...], boundary: str) -> Callable:
    """``tap(column, axis, offset)`` under a boundary rule; ``raw`` (attribute) is null past an end."""
    known(boundary)

    def raw(column: Column, axis: int, offset: int) -> Column:
        if not offset:
            return column
        line = W.partitionBy("_b", *[f"_g{e}" for e in range(len(shape)) if e != axis]).orderBy(f"_g{axis}")
        return F.lead(column, offset).over(line) if offset > 0 else F.lag(column, -offset).over(line)

    def tap(column: Column, axis: int, offset: int) -> Column:
        there = raw(column, axis, offset)
        if not offset or boundary == "periodic":
            return there
        step = 1 if offset > 0 else -1
        if boundary == "neumann":
            if abs(offset) == 1:
                return F.coalesce(there, column)
            # Only lines that end there fall short: their last cell stands in, whatever the reach.
            line = W.partitionBy("_b", *[f"_g{e}" for e in range(len(shape)) if e != axis]).orderBy(f"_g{axis}").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            return F.coalesce(there, (F.last if step > 0 else F.first)(column).over(line))
        if boundary == "dirichlet":
            return F.coalesce(there, F.lit(0.0))
        n, i = shape[axis], F.col(f"i{axis}")
        out = there
        # Past an end the line is mirrored about the end cell.
        for near in range(min(abs(offset), n)):
            back = near - min(abs(offset) - near, n - 1)
            at = i == near if step < 0 else i == n - 1 - near
            out = F.when(at, raw(column, axis, step * back)).otherwise(out)
        return out

    tap.raw = raw
    return tap


def run_pass(ws: Workspace, jobs: list[tuple[Node, list[Value]]], registry, periodic: bool) -> dict[Node, Value]:
    """Evaluate several stencil nodes with one exchange; the frame keeps all its columns."""
    plans, tapped = [], {f"i{d}" for d in range(len(ws.shape))}
    for node, values in jobs:
        named = []
        for v in values:
            if not isinstance(v, Value):
                raise ExpressionError(f"{node.op} of a value reduced along an axis: ask for keepdim=True")
            named.append(v if v.is_number else Value(v.kind, ws.keep(*v.columns), v.size))
        if not named or named[0].is_number:
            raise ExpressionError(f"{node.op} needs a field")
        tapped |= {ws.name_of(c) for v in named if not v.is_number for c in v.columns}
        plans.append((node, registry[node.op].stencil(node, named, ws.shape)))
    reach = max(p.reach for _, p in plans)
    axes = tuple(sorted({d for _, p in plans for d in p.axes}))
    kept, done, columns = list(ws.df.columns), {}, []
    near, reader = _added_up(ws, plans) if ws.in_order else (None, None)
    if near is None:
        near, reader = with_halo(ws.df, ws.shape, axes, reach, periodic, tapped), lambda boundary: tapper(ws.shape, boundary)
        kept_rows = [F.col("_own")]
    else:
        kept_rows = []
    for node, plan in plans:
        out = plan.combine(reader(node.param("boundary", "neumann")))
        names = [ws.fresh() for _ in out]
        columns += [c.alias(n) for c, n in zip(out, names)]
        done[node] = Value(plan.kind, tuple(F.col(n) for n in names), plan.size)
    frame = near.select(*kept, *kept_rows, *columns)
    ws.df = frame.where("_own").drop("_own") if kept_rows else frame
    return done


def _added_up(ws: Workspace, plans) -> tuple[DataFrame | None, Callable | None]:
    """The frame with the sums that linear stencils read, and what gives references to them; nothing if any operator is no such sum."""
    terms, ids = {}, count()
    recorder = lambda boundary: Recorder(ws.shape, known(boundary), ws.name_of, terms, ids)
    try:
        for node, plan in plans:
            plan.combine(recorder(node.param("boundary", "neumann")))
    except NeedsWindows:
        return None, None
    sums = list(terms.values())
    if not sums or shares(ws.shape, sums) > taps.MOST_SHARES:
        return None, None
    return add_up(ws.df, ws.shape, sums), recorder


# Derivatives ---------------------------------------------------------------------------------------------


def steps(node: Node, ndim: int) -> tuple[float, ...]:
    dx = node.param("dx", 1.0)
    dx = tuple(float(x) for x in dx) if isinstance(dx, (tuple, list)) else (float(dx),) * ndim
    if len(dx) != ndim or any(x == 0 for x in dx):
        raise ExpressionError(f"dx needs one number, or {ndim} that are not zero")
    return dx


def central(tap, v: Column, axis: int, h: float) -> Column:
    if isinstance(tap, Recorder):
        return tap.linear(v, {axis: {1: [(None, 1)], -1: [(None, -1)]}}) / F.lit(2.0 * h)
    return (tap(v, axis, 1) - tap(v, axis, -1)) / F.lit(2.0 * h)


def one_sided(tap, v: Column, axis: int, h: float, n: int, order: int = 2) -> Column:
    """Central differences inside; at the ends one-sided ones of the given order."""
    if n == 1:
        return F.lit(0.0)
    if isinstance(tap, Recorder):
        return tap.linear(v, {axis: _one_sided_weights(n, order)}, ends=False) / F.lit(2.0 * h)
    at = lambda o: tap.raw(v, axis, o)
    i = F.col(f"i{axis}")
    if order == 1 or n == 2:
        first, last = (at(1) - v) / F.lit(h), (v - at(-1)) / F.lit(h)
    else:
        first = (-3.0 * v + 4.0 * at(1) - at(2)) / F.lit(2.0 * h)
        last = (3.0 * v - 4.0 * at(-1) + at(-2)) / F.lit(2.0 * h)
    return F.when(i == 0, first).when(i == n - 1, last).otherwise((at(1) - at(-1)) / F.lit(2.0 * h))


def _one_sided_weights(n: int, order: int) -> dict:
    """Twice the step times the derivative: factors of neighbours at the first cell, the last and those between."""

    def first(t):
        return t == 0

    def last(t):
        return t == n - 1

    def inside(t):
        return (t > 0) & (t < n - 1)

    if order == 1 or n == 2:
        return {0: [(first, -2), (last, 2)], 1: [(first, 2), (inside, 1)], -1: [(last, -2), (inside, -1)]}
    return {0: [(first, -3), (last, 3)], 1: [(first, 4), (inside, 1)], -1: [(last, -4), (inside, -1)], 2: [(first, -1)], -2: [(last, 1)]}


def _derivative(tap, v: Column, axis: int, h: float, n: int, boundary: str, order: int = 2) -> Column:
    return central(tap, v, axis, h) if boundary == "periodic" else one_sided(tap, v, axis, h, n, order)


def _boundary(node: Node, default: str = "neumann") -> str:
    return known(node.param("boundary", default))


def _scalar(node: Node, v: Value) -> Column:
    if v.kind != "scalar":
        raise ExpressionError(f"{node.op} needs a scalar field, not a {v.kind}")
    return v.column


def _laplacian(node: Node, values, shape) -> StencilPlan:
    """Sum over axes of the compact second difference."""
    v, dx = _scalar(node, values[0]), steps(node, len(shape))

    second = {1: [(None, 1)], -1: [(None, 1)], 0: [(None, -2)]}

    def combine(tap):
        out = F.lit(0.0)
        if isinstance(tap, Recorder):
            # Axes of one step are one sum.
            for h in dict.fromkeys(dx):
                out = out + tap.linear(v, {d: second for d, other in enumerate(dx) if other == h}) / F.lit(h * h)
            return [out]
        for d, h in enumerate(dx):
            out = out + (tap(v, d, 1) + tap(v, d, -1) - 2.0 * v) / F.lit(h * h)
        return [out]

    return StencilPlan(1, tuple(range(len(shape))), combine)


def _gradient(node: Node, values, shape) -> StencilPlan:
    """All axes as a vector; one axis with ``dim``. Central and wrapping if periodic, else with one-sided ends."""
    v, dx, boundary, dim = _scalar(node, values[0]), steps(node, len(shape)), _boundary(node), node.param("dim")
    if dim is not None:
        d = dim % len(shape)
        return StencilPlan(2, (d,), lambda tap: [F.lit(0.0) if shape[d] == 1 else _derivative(tap, v, d, dx[d], shape[d], boundary)])
    axes = tuple(range(len(shape)))
    return StencilPlan(2, axes, lambda tap: [_derivative(tap, v, d, dx[d], shape[d], boundary) for d in axes], "vector", len(axes))


def _gradient_nd(node: Node, values, shape) -> StencilPlan:
    """One-sided ends whatever the boundary; axes of one cell are left out; first-order ends if any axis is shorter than three."""
    v, dx = _scalar(node, values[0]), steps(node, len(shape))
    axes = tuple(d for d, n in enumerate(shape) if n > 1)
    if not axes:
        raise ExpressionError("gradient_nd of a single cell")
    order = 2 if min(shape[d] for d in axes) >= 3 else 1
    return StencilPlan(2, axes, lambda tap: [one_sided(tap, v, d, dx[d], shape[d], order) for d in axes], "vector", len(axes))


def _long_enough(node: Node, shape) -> None:
    if min(shape) < 3:
        raise ExpressionError(f"{node.op} needs at least three cells along each axis")


def _divergence(node: Node, values, shape) -> StencilPlan:
    """Sum over axes of each component's derivative along its own axis."""
    t, dx, boundary = values[0], steps(node, len(shape)), _boundary(node)
    if t.kind != "vector" or t.size != len(shape):
        raise ExpressionError(f"divergence needs a vector of {len(shape)} components")
    if boundary != "periodic":
        _long_enough(node, shape)

    def combine(tap):
        out = F.lit(0.0)
        for d, c in enumerate(t.columns):
            out = out + _derivative(tap, c, d, dx[d], shape[d], boundary)
        return [out]

    return StencilPlan(2, tuple(range(len(shape))), combine)


def _curl(node: Node, values, shape) -> StencilPlan:
    """Vector in three dimensions, scalar in two; one-sided ends whatever the boundary."""
    t, dx = values[0], steps(node, len(shape))
    if len(shape) not in (2, 3) or t.kind != "vector" or (t.size != 3 if len(shape) == 3 else t.size < 2):
        raise ExpressionError("curl needs a vector of three components in 3-D or two in 2-D")
    _long_enough(node, shape)

    def combine(tap):
        d = lambda c, a: one_sided(tap, t.columns[c], a, dx[a], shape[a])
        if len(shape) == 2:
            return [d(1, 0) - d(0, 1)]
        return [d(2, 1) - d(1, 2), d(0, 2) - d(2, 0), d(1, 0) - d(0, 1)]

    return StencilPlan(2, tuple(range(len(shape))), combine, *(("vector", 3) if len(shape) == 3 else ("scalar", 1)))


def _jacobian(node: Node, values, shape) -> StencilPlan:
    """m[c, a]: derivative of component c along axis a; three components in three dimensions."""
    t, dx = values[0], steps(node, len(shape))
    if len(shape) != 3 or t.kind != "vector" or t.size != 3:
        raise ExpressionError("jacobian needs a vector of three components in 3-D")
    _long_enough(node, shape)
    return StencilPlan(2, (0, 1, 2), lambda tap: [one_sided(tap, c, a, dx[a], shape[a]) for c in t.columns for a in range(3)], "matrix", 3)


def _surface_normals(node: Node, values, shape) -> StencilPlan:
    """Unit normals (-d0, -d1, 1) of a height field in two dimensions."""
    v, dx = _scalar(node, values[0]), steps(node, len(shape))
    if len(shape) != 2:
        raise ExpressionError("surface_normals needs a 2-D field")
    _long_enough(node, shape)

    def combine(tap):
        x, y = (one_sided(tap, v, d, dx[d], shape[d]) for d in (0, 1))
        long = F.greatest(F.sqrt(x * x + y * y + 1.0), F.lit(1e-15))
        return [-x / long, -y / long, F.lit(1.0) / long]

    return StencilPlan(2, (0, 1), combine, "vector", 3)


def _material_derivative(node: Node, values, shape) -> StencilPlan:
    """Advection by a velocity: sum of v_d times the derivative along d; no derivative in time."""
    v, u, dx = _scalar(node, values[0]), values[1], steps(node, len(shape))
    if u.kind != "vector" or u.size < len(shape):
        raise ExpressionError(f"material_derivative needs a velocity of {len(shape)} components")
    if min(shape) < 2:
        raise ExpressionError("material_derivative needs at least two cells along each axis")
    order = 2 if min(shape) >= 3 else 1

    def combine(tap):
        out = F.lit(0.0)
        for d in range(len(shape)):
            out = out + u.columns[d] * one_sided(tap, v, d, dx[d], shape[d], order)
        return [out]

    return StencilPlan(2, tuple(range(len(shape))), combine)


def _smooth(node: Node, values, shape) -> StencilPlan:
    """Weights 1, 2, 1 along one axis."""
    v, d = _scalar(node, values[0]), node.param("axis")

    def combine(tap):
        if isinstance(tap, Recorder):
            return [tap.linear(v, {d: {-1: [(None, 1)], 0: [(None, 2)], 1: [(None, 1)]}}) / F.lit(4.0)]
        return [(tap(v, d, -1) + 2.0 * v + tap(v, d, 1)) / F.lit(4.0)]

    return StencilPlan(1, (d,), combine)


def _lower_gauss(node: Node, ndim: int) -> Node:
    """27-point Gaussian smoothing of a 3-D field, wrapping whatever the boundary: three separable passes."""
    if ndim != 3:
        raise ExpressionError("conv3d_spectral needs a 3-D field")
    out = node.args[0]
    for d in range(3):
        out = call("smooth_axis", out, axis=d, boundary="periodic")
    return out


def _lower_hessian(node: Node, ndim: int) -> Node:
    """Derivatives of derivatives (a wide stencil); mixed ones are taken once."""
    grid = {k: v for k, v in node.params if k in ("dx", "boundary")} | {"boundary": "neumann"}
    x = node.args[0]
    first = [call("gradient", x, dim=i, **grid) for i in range(ndim)]
    cell = {(i, j): call("gradient", first[i], dim=j, **grid) for i in range(ndim) for j in range(i, ndim)}
    return call("stack_matrix", *[cell[min(i, j), max(i, j)] for i in range(ndim) for j in range(ndim)])


def _lower_mean_curvature(node: Node, ndim: int) -> Node:
    """Divergence of the unit gradient."""
    grid = {k: v for k, v in node.params if k in ("dx", "boundary")}
    g = call("gradient_nd", node.args[0], **grid)
    unit = call("div_last", g, call("norm_last", g, eps=node.param("eps", 1e-15)))
    return call("divergence", unit, **grid)


for _name, _plan, _radius, _cost in (
    ("laplacian", _laplacian, 1, "medium"), ("gradient", _gradient, 1, "medium"), ("divergence", _divergence, 1, "medium"),
    ("curl", _curl, 1, "high"), ("gradient_nd", _gradient_nd, 1, "medium"), ("jacobian", _jacobian, 1, "high"),
    ("surface_normals", _surface_normals, 1, "high"), ("material_derivative", _material_derivative, 1, "high"),
    ("smooth_axis", _smooth, 1, "medium"),
):
    register_operator(_name, stencil=_plan, radius=_radius, cost=_cost)
for _name, _rule, _radius, _cost in (
    ("conv3d_spectral", _lower_gauss, 1, "high"),
    ("hessian", _lower_hessian, 2, "very_high"), ("mean_curvature", _lower_mean_curvature, 2, "very_high"),
):
    register_operator(_name, lower=_rule, radius=_radius, cost=_cost)
