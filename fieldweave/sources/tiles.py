"""Division of a grid into shards and tiles with overlap, as DataFrames with a part number."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.field import Field


def decompose_field(field: Field, parts: int, dim: int = 0, overlap: int = 0) -> DataFrame:
    """Cells with ``part`` (equal stretches of one axis, the last may be shorter) and ``ghost``: cells within ``overlap`` of a part's ends also go to it."""
    return tiles(field, tuple(math.ceil(n / parts) if d == dim else n for d, n in enumerate(field.shape)), overlap).withColumnRenamed("tile", "part")


def tiles(field: Field, tile_shape: tuple[int, ...], overlap: int = 0) -> DataFrame:
    """Cells with ``tile`` (row-major number) and ``ghost`` for those that lie only in a tile's overlap. Each cell is sent to its own tile and the neighbours it overlaps."""
    if len(tile_shape) != field.ndim or overlap < 0 or overlap > min(tile_shape):
        raise ValueError("tile_shape needs a size for each axis, and the overlap may not exceed it")
    df = field.df.withColumn("tile", F.lit(0).cast("long")).withColumn("ghost", F.lit(False))
    for d, (n, t) in enumerate(zip(field.shape, tile_shape)):
        count, i = math.ceil(n / t), F.col(f"i{d}")
        home = F.floor(i / t)
        entry = lambda k, g: F.struct((F.col("tile") * count + k).alias("t"), (F.col("ghost") | F.lit(g)).alias("g"))
        near = [F.when((i % t < overlap) & (home > 0), entry(home - 1, True)), F.when((t - 1 - i % t < overlap) & (home < count - 1), entry(home + 1, True))]
        spread = F.array_compact(F.array(entry(home, False), *near)) if overlap and count > 1 else F.array(entry(home, False))
        rest = [c for c in df.columns if c not in ("tile", "ghost")]
        df = df.select(*rest, F.explode(spread).alias("_e")).select(*rest, F.col("_e.t").alias("tile"), F.col("_e.g").alias("ghost"))
    return df
