"""Fields from NumPy arrays and back, for tests."""

from itertools import product

import numpy as np

from fieldweave import Field
from fieldweave.field import coords, value_names


#: Whether fields claim that their cells stand in order, which tests set to try both ways of stencils.
IN_ORDER = False


def to_field(spark, array, kind="scalar", size=1, **grid):
    """A field of an array whose trailing axes are the components."""
    spatial = array.ndim - {"scalar": 0, "vector": 1, "matrix": 2}[kind]
    shape = array.shape[:spatial]
    names = value_names(kind, size)
    rows = [(*map(int, at), *map(float, np.ravel(array[at]))) for at in product(*map(range, shape))]
    schema = ", ".join([f"{c} int" for c in coords(spatial)] + [f"{n} double" for n in names])
    return Field(spark.createDataFrame(rows, schema), shape, kind, size, **{"in_order": IN_ORDER, **grid})


def to_array(result):
    """The values of a result as an array; components come last."""
    rows = result.df.toPandas()
    names = ["v"] if result.kind == "scalar" else value_names(result.kind, result.size)
    out = np.full((*result.shape, len(names)), np.nan)
    at = tuple(rows[f"i{d}"] for d in range(len(result.shape)))
    assert len(rows) == np.prod(result.shape)
    for k, n in enumerate(names):
        out[(*at, k)] = rows[n]
    return out[..., 0] if len(names) == 1 else out
