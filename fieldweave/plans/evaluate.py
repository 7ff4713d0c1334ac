"""Evaluate field expressions: the main entry point."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

import fieldweave.operators  # noqa: F401  registers the operators
from fieldweave.field import Field
from fieldweave.functions.registry import REGISTRY, lower_tree
from fieldweave.plans.expression import ExpressionError, parse
from fieldweave.plans.workspace import Evaluator, Workspace, result_frame


@dataclass(frozen=True)
class Result:
    """What an expression gives: a DataFrame (lazy), the grid's shape (empty for numbers) and the kind of value."""

    df: DataFrame
    shape: tuple[int, ...]
    kind: str
    size: int
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()

    @property
    def field(self) -> Field:
        if not self.shape:
            raise ExpressionError("the result is a number, not a field")
        keep = len(self.spacing) == len(self.shape)
        return Field(self.df, self.shape, self.kind, self.size, self.spacing if keep else (), self.origin if keep else ())

    @property
    def value(self):
        """The number, or pair of numbers, of a full reduction (runs the query)."""
        if self.shape:
            raise ExpressionError("the result is a field; use .df or .field")
        row = self.df.first()
        return row[0] if self.kind == "number" else tuple(row)


def evaluate(expression: str, fields: Mapping[str, Field], dx=1.0, boundary: str = "neumann", constants: Mapping[str, float] | None = None) -> Result:
    """Evaluate an expression over named fields of one shape. Nothing runs until the result is used.

    ``dx`` and ``boundary`` apply to the stencil operators that a call gives none; integrals and spectral
    operators take only their own ``dx``. ``constants`` are names of numbers.
    """
    constants = {k: float(v) for k, v in (constants or {}).items()}
    if clash := set(constants) & set(fields):
        raise ExpressionError(f"{sorted(clash)} are both fields and constants")
    tree = parse(expression, {*fields, *constants}, REGISTRY, dx, boundary)
    first = next(iter(fields.values()), None)
    if first is None:
        raise ExpressionError("an expression needs a field")
    used = _names(tree)
    ws = Workspace({k: f for k, f in fields.items() if k in used} or {k: f for k, f in list(fields.items())[:1]})
    from fieldweave.plans.workspace import Value
    from pyspark.sql import functions as F

    for k, v in constants.items():
        ws.values[k] = Value("number", (F.lit(v),))
    value = Evaluator(ws, REGISTRY).run(lower_tree(tree, ws.ndim))
    df, shape, kind, size = result_frame(ws, value)
    return Result(df, shape, kind, size, first.spacing, first.origin)


def _names(node) -> set[str]:
    own = {node.param("name")} if node.op == "field" else set()
    return own.union(*map(_names, node.args)) if node.args else own
