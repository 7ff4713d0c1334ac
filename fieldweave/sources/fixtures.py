"""Fields derived from relational test tables, by exact integer sums so that every engine starts from the same bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.field import Field, coords, densify

G3_SHAPE = (50, 11, 9)
P2_SHAPE = (50, 25)
S1_SHAPE = (2499,)
S2_SHAPE = (720,)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("bigint")).cast("double")


def g3(spark: SparkSession, sf_dir: str) -> dict[str, Field]:
    """Volume over quantity, discount and tax: ``f`` revenue, ``n`` number of lines, ``w`` their vector (f, n/10, i*n/100), ``k`` a sparse mask."""
    cells = (
        _table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_quantity").cast("int") - 1).alias("i0"),
            F.round(F.col("l_discount") * 100).cast("int").alias("i1"),
            F.round(F.col("l_tax") * 100).cast("int").alias("i2"),
        )
        .agg((_cents("l_extendedprice") / 1e8).alias("v0"), F.count(F.lit(1)).cast("double").alias("v1"))
    )
    dense = densify(cells, G3_SHAPE, "vector", 2).df
    n = F.col("v1")
    mask = F.when((n > 0) & (n % 5 == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    full = dense.select(*coords(3), "v0", "v1", (n / 10).alias("a1"), (F.col("i0") * n / 100).alias("a2"), mask.alias("mask"))
    pick = lambda *named, **kw: Field(full.select(*coords(3), *[F.col(c).alias(a) for c, a in named]), G3_SHAPE, **kw)
    # One DataFrame holds all four, so expressions over them need no join.
    shared = full.select(*coords(3), F.col("v0").alias("v"), "v0", F.col("a1").alias("v1"), F.col("a2").alias("v2"))
    return {
        "f": Field(shared, G3_SHAPE),
        "w": Field(shared, G3_SHAPE, "vector", 3),
        "n": pick(("v1", "v")),
        "k": pick(("mask", "v")),
    }


def p2(spark: SparkSession, sf_dir: str) -> dict[str, Field]:
    """Retail price over size and brand number."""
    cells = (
        _table(spark, sf_dir, "part")
        .groupBy((F.col("p_size") - 1).alias("i0"), (F.regexp_replace("p_brand", "Brand#", "").cast("int") - 1).alias("i1"))
        .agg((_cents("p_retailprice") / 1e5).alias("v"))
    )
    return {"f": densify(cells, P2_SHAPE)}


def s1(spark: SparkSession, sf_dir: str) -> dict[str, Field]:
    """Revenue by day of shipping."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-02").cast("date"))
    cells = _table(spark, sf_dir, "lineitem").groupBy(day.alias("i0")).agg((_cents("l_extendedprice") / 1e8).alias("v"))
    return {"f": densify(cells, S1_SHAPE)}


def s2(spark: SparkSession, sf_dir: str) -> dict[str, Field]:
    """Value of events by hour."""
    hour = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    cells = _table(spark, sf_dir, "events").groupBy(hour.alias("i0")).agg((_cents("value") / 1e4).alias("v"))
    return {"f": densify(cells, S2_SHAPE)}


def m3(spark: SparkSession, sf_dir: str, form: str = "plain", size: int = 3) -> dict[str, Field]:
    """A matrix of ``size`` rows per vector: plain, ``symmetric`` (M + M')/2, ``shifted`` M + 2 I, or both (``raised``)."""
    vectors = _table(spark, sf_dir, "embeddings")
    at = lambda r, c: F.col("embedding")[size * r + c].cast("double")
    cell = {
        "plain": at,
        "symmetric": lambda r, c: (at(r, c) + at(c, r)) / 2,
        "shifted": lambda r, c: at(r, c) + (2.0 if r == c else 0.0),
        "raised": lambda r, c: (at(r, c) + at(c, r)) / 2 + (2.0 if r == c else 0.0),
    }[form]
    df = vectors.select(F.col("vec_id").cast("int").alias("i0"), *[cell(r, c).alias(f"m{r}{c}") for r in range(size) for c in range(size)])
    return {"m": Field(df, (vectors.count(),), "matrix", size)}
