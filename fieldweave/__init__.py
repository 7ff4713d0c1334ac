"""fieldweave: symbolic analysis of gridded fields on Spark DataFrames."""

from fieldweave.field import Field, densify, from_function, lattice
from fieldweave.functions.registry import capability_report, register_operator
from fieldweave.pipeline import Pipeline
from fieldweave.plans.evaluate import evaluate
from fieldweave.plans.graph import Graph, open_results
from fieldweave.plans.presets import preset
from fieldweave.plans.workspace import Value
from fieldweave.sources import decompose_field, ingest, load_field, open_field, save_field, tiles
from fieldweave.sources.hdf5 import open_hdf5, save_hdf5
from fieldweave.streaming import run_to_store, stream_execute, sweep

__all__ = [
    "Field", "Graph", "Pipeline", "Value", "capability_report", "decompose_field", "densify", "evaluate", "from_function", "ingest", "lattice",
    "load_field", "open_field", "open_hdf5", "open_results", "preset", "register_operator", "run_to_store", "save_field", "save_hdf5", "stream_execute", "sweep", "tiles",
]


def __getattr__(name: str):
    """``fieldweave.laplacian("f")`` builds a pipeline that applies the operator."""
    from fieldweave.functions.registry import REGISTRY
    from fieldweave.plans.expression import ALIASES

    if ALIASES.get(name, name) in REGISTRY:
        return lambda expression="f", **settings: Pipeline(name, expression, **settings)
    raise AttributeError(name)
