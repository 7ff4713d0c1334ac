"""Sweeps of a number through an expression.

What does not depend on the number is evaluated once. Where the rest is pointwise or reduces all cells, the steps stand beside the cells in one
frame, and reductions are grouped by step: a thousand steps read the fields once. Stencils and line transforms of what depends on
the number have one plan a step.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import fieldweave.operators  # noqa: F401  registers the operators
from fieldweave.field import Field, value_names
from fieldweave.functions.registry import REGISTRY, lower_tree
from fieldweave.operators import pointwise
from fieldweave.plans.evaluate import evaluate
from fieldweave.plans.expression import ExpressionError, Node, parse
from fieldweave.plans.workspace import Evaluator, Reduced, Value, Workspace

#: Reductions of all cells, which a sweep groups by step.
GROUPED = {"sum", "mean", "norm_l2", "min_max", "variance", "covariance", "correlation", "surface_integral", "integrate"}
#: Steps of one plan, which bound the tables of numbers that are broadcast.
MOST_STEPS = 100_000


def sweep(expression: str, fields: Mapping[str, Field], name: str, start: float, stop: float, steps: int, dx=1.0, boundary: str = "neumann", constants: Mapping[str, float] | None = None) -> DataFrame:
    """The expression for each of ``steps`` evenly spaced values of the number ``name``, as rows marked by a column of that name."""
    if steps < 1:
        raise ValueError("a sweep needs a step")
    if name in fields:
        raise ExpressionError(f"{name!r} is a field and the number to sweep")
    width = (stop - start) / (steps - 1) if steps > 1 else 0.0
    constants = {k: float(v) for k, v in (constants or {}).items()}
    ws = Workspace(dict(fields))
    tree = lower_tree(parse(expression, {*fields, *constants, name}, REGISTRY, dx, boundary), ws.ndim)
    if steps > MOST_STEPS or not _together(tree, name):
        return _one_by_one(expression, fields, name, [start + k * width for k in range(steps)], dx=dx, boundary=boundary, constants=constants)
    for k, v in constants.items():
        ws.values[k] = Value("number", (F.lit(v),))
    evaluator = Evaluator(ws, REGISTRY)
    free = _independent(tree, name)
    if free:
        ws.keep(*[c for v in evaluator.run_all(free) if isinstance(v, Value) and not v.is_number for c in v.columns])
    key = ws.fresh()
    ws.sweep(key, steps)
    at = F.lit(start) + F.col(key) * F.lit(width)
    ws.values[name] = Value("number", (at,))
    value = evaluator.value(tree)
    if isinstance(value, Reduced):
        raise ExpressionError("a sweep reduces all cells or none")
    if value.is_number:
        return ws.steps.select(at.alias(name), *[c.alias(n) for c, n in zip(value.columns, ["v"] if value.kind == "number" else ["lo", "hi"])])
    return ws.df.select(at.alias(name), *ws.axes, *[c.alias(n) for c, n in zip(value.columns, value_names(value.kind, value.size))])


def _depends(node: Node, name: str) -> bool:
    return node.op == "field" and node.param("name") == name or any(_depends(a, name) for a in node.args)


def _together(node: Node, name: str) -> bool:
    """Whether all that depends on the number is pointwise, or reduces all cells."""
    if not _depends(node, name) or node.op == "field":
        return True
    operator = REGISTRY[node.op]
    plain = operator.build is not None and (operator.build.__module__ == pointwise.__name__ or node.op in GROUPED and node.param("dim") is None and node.param("dims") is None)
    return plain and all(_together(a, name) for a in node.args)


def _independent(node: Node, name: str) -> list[Node]:
    """The largest parts that do not depend on the number."""
    if not _depends(node, name):
        return [node]
    return list(dict.fromkeys(part for a in node.args for part in _independent(a, name)))


def _one_by_one(expression: str, fields: Mapping[str, Field], name: str, values: list[float], constants: Mapping[str, float], **how) -> DataFrame:
    out = None
    for v in values:
        one = evaluate(expression, fields, constants={**constants, name: v}, **how).df.select(F.lit(v).alias(name), "*")
        out = one if out is None else out.unionByName(one)
    return out
