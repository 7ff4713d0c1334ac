"""Fields on disk: Parquet data with a JSON description beside it, and ingestion of other tables."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.field import Field, coords, densify, value_names
from fieldweave.sources.hdf5 import open_hdf5, save_hdf5

#: Columns that may hold a grid's spacing, in the order they are looked for.
SPACING_HINTS = ("spacing", "dx", "voxel_size", "resolution")
#: Longest side of a block of cells that stand together in storage.
BLOCK_SIDE = 128
#: Endings of paths of HDF5 files; any other path is a folder of Parquet.
HDF5_ENDINGS = (".h5", ".hdf5")


def morton(block: list[Column], bits: int) -> Column:
    """The bits of several numbers in turn, highest first: neighbours in any direction stand near each other in this order."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for d, b in enumerate(reversed(block)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(b.cast("long"), bit).bitwiseAND(F.lit(1)), bit * len(block) + d))
    return out


def block_sides(shape: tuple[int, ...], blocks: bool | int | Sequence[int] = True) -> tuple[int, ...]:
    """Sides of blocks: as given, or at most BLOCK_SIDE along every axis."""
    if isinstance(blocks, Sequence):
        if len(blocks) != len(shape) or any(b < 1 for b in blocks):
            raise ValueError(f"{len(shape)} sides of blocks are needed, not {blocks}")
        return tuple(min(int(b), n) for b, n in zip(blocks, shape))
    return tuple(min(BLOCK_SIDE if blocks is True else int(blocks), n) for n in shape)


def save_field(field: Field, path: str, partitions: int | None = None, mode: str = "overwrite", blocks: bool | int | Sequence[int] | None = None, in_order: bool = False) -> str:
    """Write a field: ``path/data``, and ``path/field`` with its description.

    Cells stand in order of their axes, so that slices of the first prune row groups. With ``blocks`` (sides, one for all axes, or True) they stand block after block
    along a curve that keeps blocks that touch together, one block a row group, so that slices of any axis prune. ``in_order`` says that cells
    come as they are to stand, as those of a stored field do, and are neither exchanged nor sorted. A path that ends like an HDF5 file becomes one.
    """
    if path.endswith(HDF5_ENDINGS):
        return save_hdf5(field, path, mode)
    df, at = field.df.select(*coords(field.ndim), *field.columns), coords(field.ndim)
    order, writer = at, None
    if in_order:
        writer = df.write
    elif blocks and field.ndim > 1:
        sides = block_sides(field.shape, blocks)
        counts = [-(-n // b) for n, b in zip(field.shape, sides)]
        bits = max((c - 1).bit_length() for c in counts)
        if bits * field.ndim > 63:
            raise ValueError(f"blocks of {sides} are too many")
        df = df.withColumn("_z", morton([F.floor(F.col(c) / b) for c, b in zip(at, sides)], bits))
        order = ["_z", *at]
        df = df.repartitionByRange(partitions, "_z") if partitions else df.repartitionByRange("_z")
        # Cells of a partition fill row groups of a block's size each.
        writer = df.sortWithinPartitions(*order).drop("_z").write.option("parquet.block.row.count.limit", math.prod(sides))
    else:
        df = df.repartitionByRange(partitions, "i0") if partitions else df.repartitionByRange("i0")
        writer = df.sortWithinPartitions(*order).write
    writer.mode(mode).parquet(f"{path}/data")
    describe(field.df.sparkSession, path, mode, shape=field.shape, spacing=field.spacing, origin=field.origin, kind=field.kind, size=field.size)
    return path


def describe(spark: SparkSession, path: str, mode: str = "overwrite", **about) -> None:
    """Write the description of a stored field beside its data."""
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/field")


def open_field(spark: SparkSession, path: str) -> Field:
    """A stored field, or that of an HDF5 file, lazily: slices and unused values never leave the scan."""
    if path.endswith(HDF5_ENDINGS):
        return open_hdf5(spark, path)
    about = json.loads(spark.read.text(f"{path}/field").first()[0])
    names = value_names(about["kind"], about["size"])
    schema = ", ".join([f"{c} int" for c in coords(len(about["shape"]))] + [f"{n} double" for n in names])
    return Field(spark.read.schema(schema).parquet(f"{path}/data"), tuple(about["shape"]), about["kind"], about["size"], tuple(about["spacing"]), tuple(about["origin"]), in_order=True)


def load_field(spark: SparkSession, path: str, mode: str = "lazy", max_eager_gb: float = 0.5, normalize: bool = False, **how) -> Field:
    """A stored field: ``lazy``; ``eager`` caches it (MemoryError beyond the limit); ``auto`` caches it if it is within the limit. ``normalize`` ingests another table first."""
    if mode not in ("lazy", "eager", "auto"):
        raise ValueError("mode is lazy, eager or auto")
    field = ingest(spark, path, **how) if normalize else open_field(spark, path)
    gb = field.cells * 8 * len(field.columns) / 1e9
    if mode == "eager" and gb > max_eager_gb:
        raise MemoryError(f"{gb:.3g} GB is more than max_eager_gb={max_eager_gb}")
    if mode != "lazy" and gb <= max_eager_gb:
        field.df.cache()
    return field


def ingest(
    spark: SparkSession,
    source: str | DataFrame,
    coordinate_columns: Sequence[str] = ("i0", "i1", "i2"),
    value_column: str | None = None,
    shape: Sequence[int] | None = None,
    spacing: float | Sequence[float] | None = None,
    origin: Sequence[float] | None = None,
    format: str = "parquet",
    fill: float = 0.0,
    aggregate: str = "sum",
    **options,
) -> Field:
    """A scalar field from any table: coordinate columns of integers, one value column (else ``field``, ``data``, ``v``, or the first that is numeric, with a warning).

    Rows of one cell are combined by ``aggregate``, cells without rows get ``fill``. Spacing is taken from the argument, else from a
    column named like one of the hints (one value repeated for each axis), else 1.0 with a warning.
    """
    df = source if isinstance(source, DataFrame) else spark.read.format(format).options(**options).load(source)
    at = [c for c in coordinate_columns if c in df.columns]
    if not at:
        raise KeyError(f"none of {list(coordinate_columns)} in {df.columns}")
    if value_column is None:
        value_column = next((c for c in ("field", "data", "v") if c in df.columns), None)
        if value_column is None:
            numeric = [n for n, t in df.dtypes if n not in at and n not in SPACING_HINTS and t.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
            if not numeric:
                raise KeyError(f"no numeric value column in {df.columns}")
            value_column = numeric[0]
            warnings.warn(f"values are taken from column {value_column!r}", stacklevel=2)
    elif value_column not in df.columns:
        raise KeyError(f"{value_column!r} is not in {df.columns}")
    hint = next((h for h in SPACING_HINTS if h in df.columns), None)
    wanted = ([] if shape else [F.max(c).alias(c) for c in at]) + ([F.first(hint, ignorenulls=True).cast("double").alias("_h")] if spacing is None and hint else [])
    found = df.agg(*wanted).first().asDict() if wanted else {}
    shape = tuple(int(n) for n in shape) if shape else tuple(int(found[c]) + 1 for c in at)
    if spacing is None:
        if found.get("_h") is None:
            warnings.warn("no spacing is given or found; 1.0 is used", stacklevel=2)
        spacing = found.get("_h") or 1.0
    spacing = (float(spacing),) * len(at) if isinstance(spacing, (int, float)) else tuple(spacing)
    cells = df.groupBy(*[F.col(c).cast("int").alias(f"i{d}") for d, c in enumerate(at)]).agg(getattr(F, aggregate)(F.col(value_column).cast("double")).alias("v"))
    return densify(cells, shape, fill=fill, spacing=spacing, origin=tuple(origin or ()))
