"""Product codes of vectors against plain Lloyd rounds, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import vector_codes
from fieldweave.llm.vector_codes import compress, label_errors, most, part_edges, quantize

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of every whole row, by full comparisons in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    edges, codes, errors, books = part_edges(len(kept[0][1]), parts), [], [0] * len(kept), []
    for a, b in zip(edges, edges[1:]):
        x = [r[1][a:b] for r in kept]
        book = [list(v) for v in x[:entries]]
        near = lambda v: min((sum((c - d) ** 2 for c, d in zip(v, e)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            at = [near(v)[1] for v in x]
            for e in range(len(book)):
                mine = [v for v, k in zip(x, at) if k == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        found = [near(v) for v in x]
        codes.append([k for _, k in found])
        errors = [e + d for e, (d, _) in zip(errors, found)]
        books.append(book)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((r[0], "".join(f"{c[k]:02x}" for c in codes), errors[k], by_label[r[2]], digest) for k, r in enumerate(kept)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert rows_of(compress(df)) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_many_ties(spark):
    """Few distinct coordinates: equal entries, entries without parts and equally near entries."""
    dice = np.random.default_rng(4)
    rows = [(int(k), [float(c) / 4096 for c in dice.integers(-2, 3, 16)], int(k) % 3 if k % 5 else None) for k in dice.permutation(300)]
    assert rows_of(compress(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_bounds_spare_comparisons(spark):
    dice = np.random.default_rng(5)
    centres = dice.normal(size=(16, 16)) * 5
    rows = [(k, (centres[k % 16] + dice.normal(size=16) * 0.01).tolist(), 0) for k in range(800)]
    counts = []
    codes, _ = quantize(spark.createDataFrame(rows, SCHEMA), counts=counts)
    assert codes.count() == 800 and counts[0] == 800 * 8 and max(counts[2:]) < 800
    assert rows_of(compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


ODD = [
    (1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, None, 1), (3, [0.1] * 7 + [None], None), (4, [float("nan")] * 8, 2), (5, [float("inf")] * 8, 2),
    (None, [-0.3] * 8, None), (6, [-0.0001] * 8, None), (7, [0.25] * 8, 2), (None, None, None),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("code", "error", "Label_Error", "x", "at", "Vec_Id", "EMBEDDING", "sums", "of")])
    got = rows_of(compress(df))
    assert got == brute(ODD) and len(got) == 5
    assert got == rows_of(compress(df.repartition(4)))


def test_other_lengths_and_sizes(spark):
    """Other lengths than the first's and components too large for 63 bits go; 8 need not divide the length."""
    rows = [(1, [0.5] * 11, 1), (2, [0.4] * 11, 1), (3, [0.4] * 8, 1), (4, [], 1), (5, [3e38] * 11, 1), (6, [0.45] * 11, 2)]
    assert rows_of(compress(spark.createDataFrame(rows, SCHEMA))) == brute([r for r in rows if r[0] not in (3, 4, 5)])
    large = [(k, [(-1) ** k * float(most(8) // 4096 - 1000)] * 8, 1) for k in range(20)]
    got = rows_of(compress(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")))
    assert len(got) == 20 and all(r[2] >= 0 for r in got)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert compress(empty).collect() == [] and compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


@pytest.mark.parametrize("labels", [100_000, 0])
def test_label_sums(spark, monkeypatch, labels):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", labels)
    rows = [(k, None if k % 3 == 0 else "hot" if k % 3 == 1 else f"l{k}", k) for k in range(60)]
    got = label_errors(spark.createDataFrame(rows, "vec_id long, label string, error long")).collect()
    want = {}
    for _, label, e in rows:
        want[label] = want.get(label, 0) + e
    assert len(got) == 60 and all(r.label_error == want[r.label] for r in got)
