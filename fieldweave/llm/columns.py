"""Columns of given tables by name, where other columns' names may differ from them in case only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """Where a column stands: the one of exactly this name, else the only one of it in another case."""
    if name in df.columns:
        return df.columns.index(name)
    found = [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise KeyError(f"{name!r} is not one of {df.columns}")
    return found[0]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns of the given names, under new ones: ``pick(docs, doc_id="id")``. Chosen by place, so no other column clashes."""
    places = {new: place(df, old) for new, old in names.items()}
    by_place = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    return by_place.select(*[F.col(f"_{k}").alias(new) for new, k in places.items()])
