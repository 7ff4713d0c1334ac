"""Evaluation of operator trees over one growing DataFrame.

All fields of an expression are joined on their coordinates once. Pointwise operators only build
Column expressions over that frame. Stencil operators whose operands are ready are evaluated together in
one pass: one exchange by blocks of the grid serves all their axes. Reductions become scalar subqueries, so a
rank-0 value combines with a field without a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.field import Field, coords, value_names
from fieldweave.plans.expression import ExpressionError, Node


@dataclass(frozen=True)
class Value:
    """What a node evaluates to: columns over the workspace's frame; or numbers (kind ``number`` or ``pair``) that need none."""

    kind: str
    columns: tuple[Column, ...]
    size: int = 1

    @property
    def is_number(self) -> bool:
        return self.kind in ("number", "pair")

    @property
    def column(self) -> Column:
        return self.columns[0]


class Reduced:
    """A value on a smaller grid (an axis was reduced); it is a result and not an operand."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...]):
        self.df, self.shape = df, shape


class Workspace:
    def __init__(self, fields: dict[str, Field]):
        if not fields:
            raise ExpressionError("an expression needs a field")
        shapes = {f.shape for f in fields.values()}
        if len(shapes) != 1:
            raise ExpressionError(f"fields differ in shape: {sorted(shapes)}")
        self._ids = count()
        self.shape = shapes.pop()
        self.axes = coords(len(self.shape))
        self.values: dict[str, Value] = {}
        self.df: DataFrame | None = None
        #: The one node that is asked for, if there is no other: when it is built, nothing else in the frame is needed.
        self.only: Node | None = None
        #: While a parameter is swept: the column that tells its steps apart, and one row a step with the numbers found for it.
        self.keys: list[str] = []
        self.steps: DataFrame | None = None
        #: By identity of a Column: the column itself, so it is not reused, and its reference in the frame.
        self._kept: dict[int, tuple[Column, Column]] = {}
        self._names: dict[int, str] = {}
        #: The frame as long as its cells stand in order of their axes, as the fields' do.
        self._ordered: DataFrame | None = None
        frames: dict[int, list[str]] = {}
        for name, f in fields.items():
            frames.setdefault(id(f.df), []).append(name)
        for names in frames.values():
            # Fields that are columns of one DataFrame need no join.
            own, cols = fields[names[0]].df, {}
            for name in names:
                f = fields[name]
                named = [(c, f"c{next(self._ids)}") for c in f.columns]
                cols.update({new: F.col(c).cast("double").alias(new) for c, new in named})
                self.values[name] = Value(f.kind, tuple(self._remember(F.col(new), new) for _, new in named), f.size)
            part = own.select(*self.axes, *cols.values())
            self.df = part if self.df is None else self.df.join(part, self.axes)
        if len(frames) == 1 and all(f.in_order for f in fields.values()):
            self._ordered = self.df

    @property
    def in_order(self) -> bool:
        return self._ordered is self.df

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def fresh(self) -> str:
        return f"c{next(self._ids)}"

    def keep(self, *columns: Column) -> tuple[Column, ...]:
        """Add columns to the frame, each once; returns references to them."""
        new = [c for c in {id(c): c for c in columns}.values() if id(c) not in self._kept]
        names = [self.fresh() for _ in new]
        if new:
            ordered = self.in_order
            self.df = self.df.select("*", *[c.alias(n) for c, n in zip(new, names)])
            self._ordered = self.df if ordered else None
        for c, n in zip(new, names):
            self._remember(c, n)
        return tuple(self._kept[id(c)][1] for c in columns)

    def _remember(self, column: Column, name: str) -> Column:
        """Note under which name a column stands in the frame; a reference stands for itself."""
        reference = F.col(name)
        self._kept[id(column)] = (column, reference)
        self._kept[id(reference)] = (reference, reference)
        self._names[id(reference)] = name
        return reference

    def name_of(self, reference: Column) -> str:
        """The name in the frame of a column that ``keep`` returned."""
        return self._names[id(reference)]

    def number(self, aggregate: Column, where: DataFrame | None = None) -> Column:
        """An aggregate over the frame, as a scalar subquery; of each step of a sweep, as a column."""
        frame = self.df if where is None else where
        if not self.keys:
            return frame.agg(aggregate.alias("x")).scalar()
        name = self.fresh()
        table = F.broadcast(frame.groupBy(*self.keys).agg(aggregate.alias(name)))
        self.df, self.steps = self.df.join(table, self.keys), self.steps.join(table, self.keys)
        return F.col(name)

    def sweep(self, key: str, steps: int) -> None:
        """From here on the frame holds every cell once a step; ``key`` numbers the steps. Their number bounds the tables of numbers, which are broadcast."""
        self.df = self.df.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        self.steps = self.df.sparkSession.range(steps).select(F.col("id").cast("int").alias(key))
        self.keys = [key]


class Evaluator:
    def __init__(self, workspace: Workspace, registry):
        self.ws, self.registry, self.done = workspace, registry, {}

    def run(self, root: Node):
        self.ws.only = root
        return self.run_all([root])[0]

    def run_all(self, roots: list[Node]) -> list:
        """Evaluate several trees over the one frame: stencils of all that are ready at a time share an exchange, and equal nodes are evaluated once."""
        from fieldweave.operators.stencil import run_pass

        while True:
            ready = list(dict.fromkeys(node for root in roots for node in self._ready(root)))
            if not ready:
                break
            jobs = [(node, [self.value(a) for a in node.args]) for node in ready]
            for periodic in (False, True):
                some = [j for j in jobs if self.registry[j[0].op].wraps(j[0]) == periodic]
                if some:
                    self.done.update(run_pass(self.ws, some, self.registry, periodic))
        return [self.value(root) for root in roots]

    def _ready(self, root: Node) -> list[Node]:
        """Stencil nodes not yet evaluated whose operands hold no other such node."""
        found: dict[Node, None] = {}
        pending: dict[Node, bool] = {}

        def visit(node: Node) -> bool:
            if node in self.done:
                return False
            if node in pending:
                return pending[node]
            below = [visit(a) for a in node.args]
            own = self.registry[node.op].stencil is not None
            if own and not any(below):
                found[node] = None
            pending[node] = own or any(below)
            return pending[node]

        visit(root)
        return list(found)

    def value(self, node: Node):
        if node not in self.done:
            operator = self.registry[node.op]
            args = [self.value(a) for a in node.args]
            for a in args:
                if isinstance(a, Reduced):
                    raise ExpressionError(f"{node.op} of a value reduced along an axis: ask for keepdim=True")
            self.done[node] = operator.build(self.ws, node, *args)
        return self.done[node]


def result_frame(ws: Workspace, value) -> tuple[DataFrame, tuple[int, ...], str, int]:
    """The frame of a result: coordinates and values, or one row for a number (``v``) or a pair (``lo``, ``hi``)."""
    if isinstance(value, Reduced):
        return value.df, value.shape, "scalar", 1
    if value.is_number:
        names = ["v"] if value.kind == "number" else ["lo", "hi"]
        one = ws.df.sparkSession.range(1)
        return one.select(*[c.alias(n) for c, n in zip(value.columns, names)]), (), value.kind, 1
    names = value_names(value.kind, value.size)
    return ws.df.select(*ws.axes, *[c.alias(n) for c, n in zip(value.columns, names)]), ws.shape, value.kind, value.size
