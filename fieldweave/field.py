"""Fields: DataFrames with one row per cell of a uniform grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("scalar", "vector", "matrix", "complex")


def coords(ndim: int) -> list[str]:
    return [f"i{d}" for d in range(ndim)]


def value_names(kind: str, size: int = 1) -> list[str]:
    """Names of the value columns: v; v0..; m00..; re, im."""
    if kind == "scalar":
        return ["v"]
    if kind == "vector":
        return [f"v{c}" for c in range(size)]
    if kind == "matrix":
        return [f"m{r}{c}" for r in range(size) for c in range(size)]
    if kind == "complex":
        return ["re", "im"]
    raise ValueError(f"unknown kind {kind!r}")


@dataclass(frozen=True)
class Field:
    """A dense field: coordinates ``i0..`` from 0 and DOUBLE values, on a grid of a given shape, spacing and origin.

    ``in_order`` tells that partitions hold cells in order of their axes, or block by block, so that neighbours mostly lie together.
    """

    df: DataFrame
    shape: tuple[int, ...]
    kind: str = "scalar"
    size: int = 1
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()
    in_order: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if not self.shape or any(int(n) != n or n < 1 for n in self.shape):
            raise ValueError(f"bad shape {self.shape}")
        for name, default in (("spacing", 1.0), ("origin", 0.0)):
            value = getattr(self, name) or (default,) * self.ndim
            if len(value) != self.ndim:
                raise ValueError(f"{name} needs {self.ndim} numbers")
            object.__setattr__(self, name, tuple(float(v) for v in value))
        missing = [c for c in [*coords(self.ndim), *self.columns] if c not in self.df.columns]
        if missing:
            raise ValueError(f"columns {missing} are missing")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def columns(self) -> list[str]:
        return value_names(self.kind, self.size)

    @property
    def cells(self) -> int:
        return math.prod(self.shape)

    def world(self) -> DataFrame:
        """The field with its world coordinates x0.. = origin + i * spacing."""
        at = [(F.lit(o) + F.col(c) * F.lit(h)).alias(f"x{d}") for d, (c, o, h) in enumerate(zip(coords(self.ndim), self.origin, self.spacing))]
        return self.df.select("*", *at)

    def slice(self, *ranges: tuple[int, int] | None) -> Field:
        """The cells of half-open index ranges, renumbered from 0; filters reach a Parquet scan."""
        df, shape, origin = self.df, list(self.shape), list(self.origin)
        for d, r in enumerate(ranges):
            if r is None:
                continue
            a, b = max(0, r[0]), min(self.shape[d], r[1])
            if a >= b:
                raise ValueError(f"empty range {r} on axis {d}")
            c = f"i{d}"
            df = df.where((F.col(c) >= a) & (F.col(c) < b)).withColumn(c, F.col(c) - F.lit(a))
            shape[d], origin[d] = b - a, origin[d] + a * self.spacing[d]
        return replace(self, df=df, shape=tuple(shape), origin=tuple(origin))

    def observed(self, name: str = "stats"):
        """The field with an Observation of rows, min, max and mean of its first value, filled by the next action."""
        from pyspark.sql import Observation

        seen = Observation(name)
        v = F.col(self.columns[0])
        return replace(self, df=self.df.observe(seen, F.count(v).alias("cells"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))), seen


def lattice(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """Every coordinate of a grid, from one distributed range."""
    rest, out = F.col("id"), []
    for d in reversed(range(len(shape))):
        out.append(F.pmod(rest, F.lit(shape[d])).cast("int").alias(f"i{d}"))
        rest = F.floor(rest / shape[d]) if d else rest
    return spark.range(math.prod(shape)).select(*reversed(out))


def from_function(spark: SparkSession, shape: tuple[int, ...], *values: Column, kind: str = "scalar", size: int = 1, **grid) -> Field:
    """A field whose values are expressions of its coordinates."""
    names = value_names(kind, size)
    if len(values) != len(names):
        raise ValueError(f"a {kind} field needs {len(names)} values")
    df = lattice(spark, shape).select("*", *[v.cast("double").alias(n) for v, n in zip(values, names)])
    return Field(df, tuple(shape), kind, size, in_order=True, **grid)


def densify(df: DataFrame, shape: tuple[int, ...], kind: str = "scalar", size: int = 1, fill: float = 0.0, **grid) -> Field:
    """A field on the whole lattice from rows for some of its cells; the others get ``fill``."""
    at, names = coords(len(shape)), value_names(kind, size)
    full = lattice(df.sparkSession, shape).join(df.select(*at, *names), at, "left")
    return Field(full.select(*at, *[F.coalesce(F.col(n).cast("double"), F.lit(float(fill))).alias(n) for n in names]), tuple(shape), kind, size, **grid)
