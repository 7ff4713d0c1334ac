"""Chunked runs that can be resumed: an expression over stored fields, one slab of the grid at a time.

A slab is read with as many cells on either side as its stencils reach, by scans that leave out all others; beyond the ends of a
periodic axis the other end's cells stand in. Each slab's result is a folder of its own that a manifest entry makes valid, so a run that was stopped
goes on after the last whole slab, and a slab that was half written is written anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fieldweave.operators  # noqa: F401  registers the operators
from fieldweave.field import Field, coords
from fieldweave.functions.registry import REGISTRY, lower_tree
from fieldweave.operators import pointwise
from fieldweave.plans.evaluate import evaluate
from fieldweave.plans.expression import ExpressionError, Node, parse
from fieldweave.sources.store import describe, open_field
from fieldweave.sources.work import delete, read_texts, write_text

#: Cells of a slab, unless its length is given.
SLAB_CELLS = 1 << 26
#: Values of operators that make numbers or look at whole fields; a slab alone does not give them.
WHOLE = "needs more than a slab and its neighbours"


def reach(node: Node, axis: int) -> int:
    """How many cells beyond a slab its result depends on, along the axis: the sum of the radii of stencils one above the other."""
    below = max((reach(a, axis) for a in node.args), default=0)
    operator = REGISTRY[node.op]
    if operator.stencil is not None:
        return below + (operator.radius if node.param("axis", axis) == axis and node.param("dim") in (None, axis) else 0)
    if node.op == "box_mean":
        return below + (node.param("window") // 2 if node.param("axis") == axis else 0)
    if node.op in ("field", "number") or operator.build is not None and operator.build.__module__ == pointwise.__name__:
        return below
    raise ExpressionError(f"{node.op} {WHOLE}")


def _boundaries(node: Node) -> set[bool]:
    """Whether stencils wrap around (True) or not, of all of them."""
    own = {node.param("boundary", "neumann") == "periodic"} if REGISTRY[node.op].stencil is not None or node.op == "box_mean" else set()
    return own.union(*map(_boundaries, node.args)) if node.args else own


def _part(field: Field, axis: int, low: int, high: int) -> Field:
    """Cells ``low`` to before ``high`` along an axis, renumbered from 0; places before 0 and from the end on are those of the other end."""
    n, c = field.shape[axis], f"i{axis}"
    pieces = [(max(low, 0), min(high, n), 0)] + [(low + n, n, -n)] * (low < 0) + [(0, high - n, n)] * (high > n)
    rows = [field.df.where((F.col(c) >= a) & (F.col(c) < b)).withColumn(c, (F.col(c) + F.lit(shift - low)).cast("int")) for a, b, shift in pieces]
    shape = tuple(high - low if d == axis else m for d, m in enumerate(field.shape))
    origin = tuple(o + low * h if d == axis else o for d, (o, h) in enumerate(zip(field.origin, field.spacing)))
    return replace(field, df=reduce(DataFrame.unionByName, rows), shape=shape, origin=origin)


def run_in_slabs(
    spark: SparkSession,
    expression: str,
    inputs: Mapping[str, str],
    out_path: str,
    axis: int = 0,
    slab: int | None = None,
    dx=1.0,
    boundary: str = "periodic",
    constants: Mapping[str, float] | None = None,
    resume: bool = True,
) -> dict:
    """Evaluate an expression of pointwise operators and stencils over stored fields, ``slab`` cells along ``axis`` at a time, and store the result.

    A run of the same expression, inputs and settings into the same path goes on where it stopped, unless ``resume`` is False. Returns shape_out, n_chunks, resumed (slabs that
    were there), min, max, mean, elapsed_s and out_path; the result opens as any stored field.
    """
    began, constants = time.time(), {k: float(v) for k, v in (constants or {}).items()}
    fields = {k: open_field(spark, path) for k, path in inputs.items()}
    first = next(iter(fields.values()))
    if not 0 <= axis < first.ndim or any(f.shape != first.shape for f in fields.values()):
        raise ExpressionError(f"no axis {axis}, or fields of different shapes")
    n = first.shape[axis]
    tree = lower_tree(parse(expression, {*fields, *constants}, REGISTRY, dx, boundary), first.ndim)
    # Two cells more, so that one-sided differences at an end of the grid find theirs however short the slab is.
    halo, wraps = reach(tree, axis) and reach(tree, axis) + 2, _boundaries(tree)
    if len(wraps) > 1:
        raise ExpressionError("stencils that wrap around and stencils that do not, in one run by slabs")
    slab = slab or max(1, min(n, SLAB_CELLS * n // first.cells))
    plan = {"expression": expression, "inputs": dict(inputs), "axis": axis, "slab": slab, "dx": dx, "boundary": boundary, "constants": constants, "shape": first.shape}
    signature = json.dumps(plan, sort_keys=True)
    done = {e["slab"]: e for e in map(json.loads, read_texts(f"{out_path}/slabs", ".json"))}
    if not resume or any(e["plan"] != signature for e in done.values()):
        delete(out_path)
        done = {}
    resumed = len(done)
    for k, low in enumerate(range(0, n, slab)):
        if k in done:
            continue
        high = min(low + slab, n)
        # Without wrapping, an end of the grid is the end of its slab too, so its rule applies there and nowhere else.
        a, b = (low - halo, high + halo) if True in wraps else (max(0, low - halo), min(n, high + halo))
        if b - a >= n:
            a, b = 0, n
        parts: dict[int, Field] = {}
        for f in fields.values():
            if id(f.df) not in parts:
                parts[id(f.df)] = _part(f, axis, a, b)
        result = evaluate(expression, {key: replace(f, df=parts[id(f.df)].df, shape=parts[id(f.df)].shape) for key, f in fields.items()}, dx, boundary, constants)
        own, c = result.field, f"i{axis}"
        rows = own.df.where((F.col(c) >= low - a) & (F.col(c) < high - a)).withColumn(c, (F.col(c) + F.lit(a)).cast("int"))
        seen, observed = replace(own, df=rows).observed(f"slab {k}")
        at = coords(first.ndim)
        seen.df.select(*at, *own.columns).repartitionByRange(f"i{axis}", *at).sortWithinPartitions(*at).write.mode("overwrite").parquet(f"{out_path}/data/slab={k}")
        entry = {"slab": k, "plan": signature, "kind": own.kind, "size": own.size, **{s: observed.get[s] for s in ("cells", "min", "max", "mean")}}
        write_text(f"{out_path}/slabs/{k}.json", json.dumps(entry))
        done[k] = entry
    kind, size, cells = done[0]["kind"], done[0]["size"], sum(e["cells"] for e in done.values())
    describe(spark, out_path, shape=first.shape, spacing=first.spacing, origin=first.origin, kind=kind, size=size)
    return {
        "shape_out": first.shape, "n_chunks": len(done), "resumed": resumed, "min": min(e["min"] for e in done.values()), "max": max(e["max"] for e in done.values()),
        "mean": sum(e["mean"] * e["cells"] for e in done.values()) / cells, "elapsed_s": time.time() - began, "out_path": out_path,
    }

