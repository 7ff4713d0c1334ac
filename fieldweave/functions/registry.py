"""The operator registry: names, builders and what the planner needs to know of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from fieldweave.plans.expression import Node


@dataclass(frozen=True)
class Operator:
    """``build`` makes a value of operands; a ``stencil`` instead says which neighbours it reads and how they combine."""

    name: str
    build: Callable | None = None
    stencil: Callable | None = None
    radius: int = 0
    cost: str = "low"
    doc: str = ""
    lower: Callable | None = None
    line: Callable | None = None

    def wraps(self, node: Node) -> bool:
        return node.param("boundary") == "periodic"


REGISTRY: dict[str, Operator] = {}
COSTS = ("low", "medium", "high", "very_high")


def register_operator(
    name: str,
    build: Callable | None = None,
    *,
    stencil: Callable | None = None,
    lower: Callable | None = None,
    line: Callable | None = None,
    radius: int = 0,
    cost: str = "low",
    doc: str = "",
    replace: bool = False,
) -> Operator:
    """Add an operator that expressions can call.

    ``build(workspace, node, *values)`` returns a Value. ``stencil(node, values, ndim)`` returns a
    ``StencilPlan``. ``lower(node, ndim)`` rewrites the call to other operators. ``line(values, **params)`` is a NumPy function of whole
    lines, many at a time: it takes an array (lines, cells) and returns one of the same shape; expressions call it with ``dim``, the axis, and its own parameters.
    """
    if sum(x is not None for x in (build, stencil, lower, line)) != 1:
        raise ValueError("give exactly one of build, stencil, lower and line")
    if cost not in COSTS:
        raise ValueError(f"cost must be one of {COSTS}")
    if name in REGISTRY and not replace:
        raise ValueError(f"operator {name!r} is registered already")
    about = doc or ((build or stencil or lower or line).__doc__ or "").strip()
    REGISTRY[name] = Operator(name, _of_lines(name, line) if line else build, stencil, radius, cost, about, lower, line)
    return REGISTRY[name]


def _of_lines(name: str, line: Callable) -> Callable:
    """A builder that applies a function of lines along the axis ``dim`` of a scalar field."""

    def build(ws, node, v):
        from fieldweave.operators.lines import adopt, along, line_cells
        from fieldweave.operators.pointwise import need
        from fieldweave.plans.expression import ExpressionError
        from fieldweave.plans.workspace import Value

        d, params = node.param("dim", 0) % ws.ndim, {k: p for k, p in node.params if k != "dim"}
        if ws.shape[d] > line_cells():
            raise ExpressionError(f"{name} needs whole lines; axis {d} has {ws.shape[d]} cells, more than the {line_cells()} that one task takes")
        df = ws.df.select(*ws.axes, need(name, v, "scalar").column.alias("v"))
        return Value("scalar", adopt(ws, node, along(df, ws.shape, (d,), ["v"], lambda x: [whole_lines(line, x, params)], ["v"]), ["v"]))

    return build


def whole_lines(line: Callable, values, params: dict):
    """The function's result, which must have the shape of what it was given."""
    out = line(values, **params)
    if getattr(out, "shape", None) != values.shape:
        raise ValueError(f"a function of lines gave {getattr(out, 'shape', type(out).__name__)} for {values.shape}")
    return out


def operator(name: str, **kw):
    """Decorator form of ``register_operator`` for builders."""

    def wrap(f):
        register_operator(name, f, **kw)
        return f

    return wrap


def lower_tree(node: Node, ndim: int) -> Node:
    """Rewrite operators that are defined by others."""
    node = Node(node.op, tuple(lower_tree(a, ndim) for a in node.args), node.params)
    rule = REGISTRY[node.op].lower
    return lower_tree(rule(node, ndim), ndim) if rule else node


def capability_report() -> str:
    """A text summary of what is registered."""
    shown = [o for n, o in sorted(REGISTRY.items()) if n not in ("number", "field")]
    lines = [f"operators: {len(shown)}"] + [f"{c}: {sum(o.cost == c for o in shown)}" for c in COSTS] + ["values: float64, complex as (re, im)", ""]
    return "\n".join(lines + [f"{o.name:22s} {o.cost:9s} radius {o.radius}" for o in shown])
