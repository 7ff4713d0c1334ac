"""Spelling variants against a plain version, collisions, and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import CLASHING, ODD, SCHEMA, lower
from fieldweave.llm import spelling
from fieldweave.llm.spelling import group_variants, hashes, near_pairs


def plain_words(rows, every=199):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def plain(rows, every=199):
    n, out, form = plain_words(rows, every), [], {}
    letters = {c for w in n for c in w}
    for w in n:
        near = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        near = {x for x in near if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out.append((w, n[w], len(near)))
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), c, near, n.get(form[w])) for w, c, near in out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(group_variants(docs)) == want and any(r[1] for r in want)


TEXTS = [
    (1, "aaaaaaa " * 5 + "aaaaaab " * 30 + "aaaaaac " * 3 + "aaaaaaaa " * 6 + "Aaaaaab aaaaaabc"),
    (2, "chained " * 900 + "chainex " * 170 + "chainxx " * 30 + "chaixxx " * 5 + "chainexx " * 5),
    (3, "équipé×s " * 9 + "equipé×s " * 60 + "équipe×s " * 60 + "ÉQUIPÉ×S " * 6 + "short word " * 20),
    (4, ("x" * 5000 + "y ") * 5 + ("x" * 5001 + "y ") * 30 + ("x" * 2500 + "z" + "x" * 2499 + "y ") * 6),
]


@pytest.mark.parametrize("bucket", [1 << 20, 50])
@pytest.mark.parametrize("every", [199, 3])
def test_chains_ties_and_long_words(spark, monkeypatch, bucket, every):
    monkeypatch.setattr(spelling, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(spelling, "STRETCH", 1 << 10)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = rows_of(group_variants(docs, every=every))
    assert got == plain(TEXTS, every)
    if every == 199:
        roots = {r[0]: r[2] for r in got}
        assert roots["chaixxx"] == "chained" and roots["aaaaaaa"] == "aaaaaab"


def test_colliding_hashes_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(spelling, "mixed", lambda key: key & np.uint64(7))
    docs = spark.createDataFrame(TEXTS[:3], "doc_id long, text string")
    assert rows_of(group_variants(docs)) == plain(TEXTS[:3])


def test_hash_of_a_deletion_is_that_of_the_shorter_word():
    words = ["abcdef", "é", "xyzzyx", "aaaa"]
    of = lambda ws: hashes(np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32), np.array([len(w) for w in ws]))
    _, rest = of(words)
    shorter = [w[:k] + w[k + 1 :] for w in words for k in range(len(w))]
    assert rest.tolist() == of(shorter)[0].tolist()


def test_pairs_both_ways_once(spark):
    words = ["planet", "planets", "plane", "plants", "planetss", "xplanets"]
    table = spark.createDataFrame(list(enumerate(words)), "number long, word string")
    got = sorted((words[r.a], words[r.b]) for r in near_pairs(table).collect())
    half = [("planet", "planets"), ("planet", "plane"), ("planets", "plants"), ("planets", "planetss"), ("planets", "xplanets")]
    assert got == sorted(half + [(b, a) for a, b in half])


def test_odd_rows(spark):
    rows = [*ODD, (7, "wordie " * 5, "en", "s", 1), (None, "wordier " * 30, "en", "s", 1), (7, "wordie " * 5, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in [*CLASHING, "Word", "N", "form", "number", "TEXT"]])
    got = rows_of(group_variants(docs))
    assert got == plain([r[:2] for r in rows]) and {r[0] for r in got} >= {"wordie", "wordier"}
    assert got == rows_of(group_variants(docs.repartition(3)))
    assert group_variants(docs.where("false")).collect() == []
