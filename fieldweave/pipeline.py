"""A fluent builder over ``evaluate``: settings, fields and constants as attributes."""

from __future__ import annotations

import logging
import math
import time

from pyspark.sql import SparkSession

from fieldweave.field import Field
from fieldweave.functions.registry import REGISTRY
from fieldweave.plans.evaluate import Result, evaluate
from fieldweave.plans.expression import ALIASES, ExpressionError
from fieldweave.sources.store import load_field, save_field
from fieldweave.streaming.measure import measured

log = logging.getLogger("fieldweave")
SETTINGS = {"output": None, "boundary": "periodic", "dx": 1.0, "load": "lazy", "report": False, "spark": None}


class Pipeline:
    """``Pipeline("laplacian", "f + a").set(dx=0.1)`` with ``p.f = field or path`` and ``p.a = 2.0``.

    An operator name is applied to the expression. Strings and fields are fields, numbers are constants, names
    of settings are settings. The run happens once, at ``run``, ``value`` or indexing; with ``output`` set the
    result is stored there too.
    """

    def __init__(self, op_name: str | None = None, expression: str = "f", **settings):
        object.__setattr__(self, "settings", dict(SETTINGS))
        object.__setattr__(self, "fields", {})
        object.__setattr__(self, "constants", {})
        object.__setattr__(self, "_result", None)
        object.__setattr__(self, "measures", None)
        if op_name is not None and ALIASES.get(op_name, op_name) not in REGISTRY:
            raise ExpressionError(f"unknown operator {op_name!r}")
        object.__setattr__(self, "expression", f"{op_name}({expression})" if op_name else str(expression))
        self.set(**settings)

    def __setattr__(self, name, value):
        object.__setattr__(self, "_result", None)
        if name in SETTINGS:
            self.settings[name] = value
        elif isinstance(value, (str, Field)):
            self.fields[name] = value
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            self.constants[name] = float(value)
        else:
            raise TypeError(f"{name}: a field, a path or a number is needed, not {type(value).__name__}")

    def set(self, **given) -> Pipeline:
        for k, v in given.items():
            setattr(self, k, v)
        return self

    def run(self) -> Result:
        if self._result is None:
            began = time.time()
            spark = self.settings["spark"] or SparkSession.getActiveSession()
            loaded = {k: f if isinstance(f, Field) else load_field(spark, f, self.settings["load"]) for k, f in self.fields.items()}
            result = evaluate(self.expression, loaded, self.settings["dx"], self.settings["boundary"], self.constants)
            if self.settings["output"] is not None:
                with measured(spark) as seen:
                    save_field(result.field, self.settings["output"])
                object.__setattr__(self, "measures", seen)
            object.__setattr__(self, "_result", result)
            log.info("%s: %.3f s", self.expression, time.time() - began)
            if self.settings["report"]:
                print(self.report())
        return self._result

    @property
    def value(self):
        """The number of a full reduction, else the result's DataFrame."""
        result = self.run()
        return result.df if result.shape else result.value

    def __getitem__(self, ranges):
        """A slice of the result: one Python slice an axis, or a pair of numbers for the first axis."""
        field = self.run().field
        if isinstance(ranges, tuple) and len(ranges) == 2 and all(isinstance(r, int) for r in ranges):
            ranges = (slice(*ranges),)
        if not isinstance(ranges, tuple):
            ranges = (ranges,)
        if len(ranges) > len(field.shape):
            raise IndexError(f"{len(ranges)} ranges for {len(field.shape)} axes")
        spans = []
        for r, n in zip(ranges, field.shape):
            begin, end, step = r.indices(n) if isinstance(r, slice) else (*r, 1)
            if step != 1:
                raise ValueError("slices take a step of 1")
            spans.append((begin, end))
        return field.slice(*spans)

    def report(self) -> str:
        """Shape and kind of the result, what storing it read, wrote and took, and Spark's plan."""
        r = self.run()
        rates = f"\n{self.measures}; {math.prod(r.shape) / max(self.measures.elapsed_s, 1e-9):.0f} cells/s" if self.measures else ""
        return f"{self.expression}: {r.kind} {r.shape or ''}{rates}\n{r.df._jdf.queryExecution().simpleString()}"
