"""Run expressions from storage to storage. Spark streams the partitions; results do not depend on how the input is cut."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import SparkSession

from fieldweave.field import Field
from fieldweave.functions.registry import REGISTRY, lower_tree
from fieldweave.operators import pointwise
from fieldweave.plans.evaluate import evaluate
from fieldweave.plans.expression import ALIASES, Node, parse
from fieldweave.sources.store import HDF5_ENDINGS, open_field, save_field
from fieldweave.sources.work import stored_bytes
from fieldweave.streaming.measure import measured


def run_to_store(spark: SparkSession, expression: str, inputs: Mapping[str, str | Field], out_path: str, dx=1.0, boundary: str = "periodic", constants=None, partitions: int | None = None) -> dict:
    """Evaluate an expression over stored fields and store the result; returns its shape, min, max, mean, seconds and path, and what was read and written, in all and a second."""
    began = time.time()
    fields = {k: f if isinstance(f, Field) else open_field(spark, f) for k, f in inputs.items()}
    cells = max(f.cells for f in fields.values())
    with measured(spark) as seen:
        result = evaluate(expression, fields, dx, boundary, constants)
        if not result.shape:
            value = result.value
            low, high = value if isinstance(value, tuple) else (value, value)
            stats = {"min": low, "max": high, "mean": value if low == high else None}
        else:
            # The statistics are gathered by the write itself.
            observed, found = result.field.observed()
            tree = lower_tree(parse(expression, {*fields, *(constants or {})}, REGISTRY, dx, boundary), len(result.shape))
            stored = len(inputs) == 1 and all(isinstance(f, str) for f in inputs.values())
            # Cells of one stored field that are worked on one by one still stand in order.
            save_field(observed, out_path, partitions, in_order=stored and not partitions and cell_by_cell(tree))
            stats = found.get
    about = {"shape_out": result.shape, **{k: stats[k] for k in ("min", "max", "mean")}, "elapsed_s": time.time() - began, "out_path": out_path if result.shape else None}
    chunks = spark.read.parquet(f"{out_path}/data").rdd.getNumPartitions() if result.shape and not out_path.endswith(HDF5_ENDINGS) else 1
    # What the stored inputs hold, as Parquet readers fetch in threads whose bytes the stages' metrics miss.
    seen.bytes_in = sum(stored_bytes(f if f.endswith(HDF5_ENDINGS) else f"{f}/data") for f in inputs.values() if isinstance(f, str)) or seen.bytes_in
    return {**about, "n_chunks": chunks, "bytes_in": seen.bytes_in, "bytes_out": seen.bytes_out, **seen.rates(cells), "measures": seen}


def cell_by_cell(node: Node) -> bool:
    """Whether an expression looks at no cell but its own."""
    operator = REGISTRY[node.op]
    return operator.build is not None and operator.build.__module__ == pointwise.__name__ and all(map(cell_by_cell, node.args))


def stream_execute(spark: SparkSession, op_name: str, input_path: str, out_path: str, dx=1.0, boundary: str = "periodic", **params) -> dict:
    """One operator over one stored field, to another."""
    name = ALIASES.get(op_name, op_name)
    if name not in REGISTRY:
        raise ValueError(f"unknown operator {op_name!r}")
    given = ", ".join(["f", *(f"{k}={v!r}" for k, v in params.items())])
    return run_to_store(spark, f"{name}({given})", {"f": input_path}, out_path, dx, boundary)
