"""Graphs of operators with several results.

Nodes are added by name and evaluated together: all results come from one frame, in which stencils that are ready at the
same time share an exchange and equal nodes are evaluated once. Results, or anything else known of a node, can be
given to a later run as its ``seed``; what lies below such a node is then not evaluated.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fieldweave.operators  # noqa: F401  registers the operators
from fieldweave.field import Field, coords, value_names
from fieldweave.functions.registry import REGISTRY, lower_tree
from fieldweave.plans.evaluate import Result
from fieldweave.plans.expression import ALIASES, TAKES_GRID, ExpressionError, Node, call, number, parse
from fieldweave.plans.workspace import Evaluator, Reduced, Workspace, result_frame

#: What a node may stand for without an operator.
Known = Field | Result | int | float


@dataclass(frozen=True)
class GraphNode:
    """An operator over other nodes, or (``value``) something known."""

    id: str
    op: str | None
    inputs: tuple[str, ...] = ()
    params: tuple[tuple[str, object], ...] = ()
    value: Known | None = None


class Graph:
    """``g.add("laplacian", [g.constant(field, "f")], node_id="lap")``. Nodes that no other node takes are its sinks."""

    def __init__(self):
        self.nodes: dict[str, GraphNode] = {}

    def __len__(self) -> int:
        return len(self.nodes)

    def __repr__(self) -> str:
        return f"Graph({len(self)} nodes)"

    def _put(self, node: GraphNode) -> str:
        if node.id in self.nodes:
            raise ExpressionError(f"node {node.id!r} exists already")
        self.nodes[node.id] = node
        return node.id

    def _name(self, node_id: str | None, kind: str) -> str:
        if node_id is not None:
            return node_id
        return next(name for k in range(len(self.nodes) + 1) if (name := f"{kind}_{k}") not in self.nodes)

    def add(self, op: str, inputs: Iterable[str] = (), params: Mapping[str, object] | None = None, node_id: str | None = None) -> str:
        """An operator over nodes; inputs may be added after it. Returns its id."""
        name = ALIASES.get(op, op)
        if name not in REGISTRY or name in ("field", "number"):
            raise ExpressionError(f"unknown operator {op!r}")
        return self._put(GraphNode(self._name(node_id, name), name, tuple(inputs), tuple(sorted((params or {}).items()))))

    def constant(self, value: Known, node_id: str | None = None) -> str:
        """A field, an earlier result or a number. Returns its id."""
        return self._put(GraphNode(self._name(node_id, "constant"), None, value=_known(value)))

    def add_expression(self, text: str, node_id: str | None = None, dx=1.0, boundary: str = "neumann") -> str:
        """The nodes of an expression over the ids of this graph's nodes; returns the id of the last."""

        def place(node: Node, own_id: str | None) -> str:
            if node.op == "field" and own_id is None:
                return node.param("name")
            if node.op == "number":
                return self.constant(node.param("value"), own_id)
            if node.op == "field":
                raise ExpressionError(f"{text!r} is a node already")
            return self.add(node.op, [place(a, None) for a in node.args], dict(node.params), own_id)

        return place(parse(text, self.nodes, REGISTRY, dx, boundary), node_id)

    def consumers(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {name: [] for name in self.nodes}
        for node in self.nodes.values():
            for name in node.inputs:
                if name not in out:
                    raise ExpressionError(f"node {node.id!r} takes an unknown node {name!r}")
                out[name].append(node.id)
        return out

    def sinks(self) -> list[str]:
        return [name for name, users in self.consumers().items() if not users]

    def order(self) -> list[GraphNode]:
        """Nodes with inputs before their users; a cycle is an error."""
        users, missing = self.consumers(), {name: len(node.inputs) for name, node in self.nodes.items()}
        out = [name for name, n in missing.items() if not n]
        for name in out:
            for user in users[name]:
                missing[user] -= 1
                if not missing[user]:
                    out.append(user)
        if len(out) < len(self.nodes):
            raise ExpressionError(f"nodes {sorted(set(self.nodes) - set(out))} form a cycle")
        return [self.nodes[name] for name in out]

    def clone_with_replacement(self, node_id: str, value: Known) -> Graph:
        """A copy in which a node stands for something known."""
        if node_id not in self.nodes:
            raise ExpressionError(f"no node {node_id!r}")
        other = Graph()
        other.nodes = {k: GraphNode(k, None, value=_known(value)) if k == node_id else n for k, n in self.nodes.items()}
        return other

    def run(self, sinks: Iterable[str] | None = None, seed: Mapping[str, Known] | None = None, dx=1.0, boundary: str = "neumann") -> Results:
        """Evaluate ``sinks`` (any nodes; else all that no node takes) together. Nothing runs until a result is used.

        ``seed`` maps nodes to what is known of them. ``dx`` and ``boundary`` apply to stencils that give none.
        """
        wanted, known = list(self.sinks() if sinks is None else sinks), {k: _known(v) for k, v in (seed or {}).items()}
        if unknown := [k for k in [*wanted, *known] if k not in self.nodes]:
            raise ExpressionError(f"no nodes {unknown}")
        trees: dict[str, Node] = {}
        fields: dict[str, Field] = {}
        needed = self._needed(wanted, known)
        for node in self.order():
            if node.id not in needed:
                continue
            value = known.get(node.id, node.value)
            if isinstance(value, Field):
                fields[node.id], trees[node.id] = value, call("field", name=node.id)
            elif value is not None:
                trees[node.id] = number(value)
            else:
                params = {**({"dx": dx, "boundary": boundary} if node.op in TAKES_GRID else {}), **dict(node.params)}
                trees[node.id] = call(node.op, *[trees[k] for k in node.inputs], **params)
        ws = Workspace(fields)
        values = Evaluator(ws, REGISTRY).run_all([lower_tree(trees[k], ws.ndim) for k in wanted])
        first = next(iter(fields.values()))
        return Results(ws, dict(zip(wanted, values)), first.spacing, first.origin)

    def _needed(self, wanted: list[str], known: Mapping[str, object]) -> set[str]:
        found, todo = set(), list(wanted)
        while todo:
            name = todo.pop()
            if name not in found:
                found.add(name)
                todo += [] if name in known else self.nodes[name].inputs
        return found


def _known(value) -> Field | float:
    if isinstance(value, Result):
        return value.field if value.shape else float(value.value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, Field):
        raise TypeError(f"a field, a result or a number is needed, not {type(value).__name__}")
    return value


class Results(Mapping):
    """Results by node, all over one frame."""

    def __init__(self, ws: Workspace, values: dict, spacing: tuple[float, ...], origin: tuple[float, ...]):
        self._ws, self._values, self._spacing, self._origin = ws, values, spacing, origin

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def __getitem__(self, node_id: str) -> Result:
        df, shape, kind, size = result_frame(self._ws, self._values[node_id])
        return Result(df, shape, kind, size, self._spacing, self._origin)

    def _cells(self) -> dict[str, list[str]]:
        """Names in the frame of the results that are fields on the whole grid."""
        whole = {k: v for k, v in self._values.items() if not isinstance(v, Reduced) and not v.is_number}
        return {k: [k] if v.kind == "scalar" else [f"{k}_{c}" for c in value_names(v.kind, v.size)] for k, v in whole.items()}

    def frame(self) -> DataFrame:
        """One row a cell: coordinates and every field, as the node's name (``name_v0``.. if it has components)."""
        named = [c.alias(n) for k, names in self._cells().items() for c, n in zip(self._values[k].columns, names)]
        return self._ws.df.select(*self._ws.axes, *named)

    def numbers(self) -> DataFrame:
        """One row with every number, as the node's name (``name_lo`` and ``name_hi`` of a pair)."""
        named = []
        for k, v in self._values.items():
            if not isinstance(v, Reduced) and v.is_number:
                named += [c.alias(n) for c, n in zip(v.columns, [k] if v.kind == "number" else [f"{k}_lo", f"{k}_hi"])]
        return self._ws.df.sparkSession.range(1).select(*named)

    def save(self, path: str, mode: str = "overwrite") -> dict[str, Field]:
        """Write all fields in one pass, and return them as stored: each reads its own columns."""
        spark, about = self._ws.df.sparkSession, {}
        for k, names in self._cells().items():
            v = self._values[k]
            about[k] = {"columns": names, "kind": v.kind, "size": v.size}
        self.frame().repartitionByRange("i0").sortWithinPartitions(*self._ws.axes).write.mode(mode).parquet(f"{path}/data")
        text = json.dumps({"shape": self._ws.shape, "spacing": self._spacing, "origin": self._origin, "fields": about})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/fields")
        return open_results(spark, path)


def open_results(spark: SparkSession, path: str) -> dict[str, Field]:
    """The fields that ``Results.save`` wrote, by node; each reads its own columns alone."""
    about = json.loads(spark.read.text(f"{path}/fields").first()[0])
    shape, axes = tuple(about["shape"]), coords(len(about["shape"]))
    columns = [c for f in about["fields"].values() for c in f["columns"]]
    frame = spark.read.schema(", ".join([f"{c} int" for c in axes] + [f"`{c}` double" for c in columns])).parquet(f"{path}/data")
    own = {k: value_names(f["kind"], f["size"]) for k, f in about["fields"].items()}
    return {
        k: Field(frame.select(*axes, *[F.col(f"`{c}`").alias(n) for c, n in zip(f["columns"], own[k])]), shape, f["kind"], f["size"], tuple(about["spacing"]), tuple(about["origin"]), in_order=True)
        for k, f in about["fields"].items()
    }
