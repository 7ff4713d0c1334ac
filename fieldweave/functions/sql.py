"""Functions of lines as SQL table functions.

``SELECT * FROM smooth(TABLE(cells), 0)`` applies a registered function of lines to a table of cells, along an axis, whatever its name for
the table is. The function itself tells Spark to partition the table by the other coordinates and to order it by that axis.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from fieldweave.functions.registry import REGISTRY, whole_lines


def register_sql_function(spark: SparkSession, name: str, **params) -> str:
    """Make the line operator ``name`` callable from the session's SQL, with these parameters. It takes a table of coordinates i0.. and v, and the axis (0 if absent)."""
    line = REGISTRY[name].line if name in REGISTRY else None
    if line is None:
        raise ValueError(f"{name!r} is no operator registered with a function of lines")

    class OfLines:
        """Gathers the cells of a line and gives them with their new values."""

        def __init__(self):
            self.cells = []

        @staticmethod
        def analyze(cells: AnalyzeArgument, dim: AnalyzeArgument | None = None) -> AnalyzeResult:
            axes = sorted((f.name for f in cells.dataType.fields if f.name[:1] == "i" and f.name[1:].isdigit()), key=lambda c: int(c[1:]))
            along = f"i{dim.value if dim is not None and dim.value is not None else 0}"
            if along not in axes or "v" not in cells.dataType.names:
                raise ValueError(f"a table of coordinates up to {along} and v is needed, not {cells.dataType.names}")
            schema = StructType([cells.dataType[c] for c in axes]).add("v", DoubleType())
            others = [PartitioningColumn(c) for c in axes if c != along]
            return AnalyzeResult(schema, withSinglePartition=not others, partitionBy=others, orderBy=[OrderingColumn(along)])

        def eval(self, cells, dim=0):
            if not self.cells:
                self.axes = sorted((c for c in cells.__fields__ if c[:1] == "i" and c[1:].isdigit()), key=lambda c: int(c[1:]))
            self.cells.append((*(cells[c] for c in self.axes), cells["v"]))

        def terminate(self):
            if self.cells:
                values = whole_lines(line, np.array([[row[-1] for row in self.cells]], float), params)
                for row, v in zip(self.cells, values[0].tolist()):
                    yield *row[:-1], v

    spark.udtf.register(name, udtf(OfLines))
    return name
