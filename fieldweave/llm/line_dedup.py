"""Line deduplication by overlapping three-line windows.

Each run of consecutive lines is hashed (128 bits), the first occurrence of every
window in (id, position) order is found by an aggregate, and all later occurrences cover
their lines; covered positions are merged for each document and those lines go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.storage import stage


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with all its columns, its text without repeated windows, and n_lines_in, n_lines_removed.

    Lines end at a line feed and are compared as they are. A window whose lines are all blank is
    no window; documents of fewer lines than ``window`` have none. An earlier occurrence is one with
    a smaller id, or the same id and an earlier line. Null texts stay null (no lines). Rows that
    repeat an id and text are one document given more than once: each gets the same result, and
    one does not make the other a later occurrence. Rows with a null id are never shortened. A
    document that loses every line keeps its row with an empty text. A column of ``docs`` named as one of the two
    counts gives way to it.
    """
    lines, own = F.split(F.col("text"), "\n", -1), [f"line{k}" for k in range(window)]
    run = lambda k: F.slice("lines", F.lit(k + 1), F.size("lines") - (window - 1)).alias(own[k])
    windows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .where(F.col("text").contains("\n"))
        .select("doc_id", lines.alias("lines"))
        .where(F.size("lines") >= window)
        # The lines from each on, side by side.
        .select("doc_id", F.posexplode(F.arrays_zip(*[run(k) for k in range(window)])).alias("pos", "w"))
        .where(reduce(lambda a, b: a | b, [F.trim(f"w.{x}") != "" for x in own]))
        .select("doc_id", "pos", F.xxhash64(*[f"w.{x}" for x in own]).alias("h1"), F.xxhash64(F.lit("second"), *[f"w.{x}" for x in own]).alias("h2")),
        "windows",
    )
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    covered = (
        windows.join(first, ["h1", "h2"])
        .where(F.struct("doc_id", "pos") > F.col("first"))
        .select("doc_id", F.explode(F.array(*[F.col("pos") + k for k in range(window)])).alias("line"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("line")).alias("gone"))
        .select("doc_id", _marks("gone").alias("marks"), F.size("gone").alias("n_gone"))
    )
    # A text is split once; each of its lines looks up its own mark.
    own, marks = F.col(f"d.`{text_col}`").cast("string"), F.col("g.marks")
    kept = F.filter(F.split(own, "\n", -1), lambda line, i: F.substring(marks, i + 1, F.lit(1)) != F.lit(b"0"))
    text = F.when(marks.isNull(), own).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(own.isNull(), 0).otherwise(F.size(F.split(own, "\n", -1)))
    report = {text_col: text, "n_lines_in": n_lines.cast("long"), "n_lines_removed": F.coalesce(F.col("g.n_gone"), F.lit(0)).cast("long")}
    others = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() not in {name.lower() for name in report}]
    return (
        docs.alias("d")
        .join(covered.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.doc_id"), "left")
        .select(*others, *[c.alias(name) for name, c in report.items()])
    )


def _marks(gone: str) -> Column:
    """A byte for each line up to the last that goes: 0 for those of the sorted positions ``gone``, 1 for others."""
    run = lambda x, i: F.concat(F.repeat(F.lit("1"), x - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1), F.lit("0"))
    return F.array_join(F.transform(gone, run), "").cast("binary")
