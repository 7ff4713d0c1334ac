"""Grouping of spelling variants: words one code point apart, found by rolling-hash deletions.

Prefix and suffix polynomial hashes of a word give the hash of the word without any one of its code points at once,
as NumPy integers. Two words are one insertion or deletion apart when one of them is the other without a code point, and one replacement apart
when both without the code point at the same place are the same. So each word sends its own hash and one key a place. Keys are
dealt to buckets by their leading bits, as packed blocks, and each bucket is sorted; equal keys stand together there. Words that meet are
compared as strings, so colliding hashes do no harm. Distinct words with the same rest at the same place differ by their letter
there, so no group is larger than the alphabet times the places of a word, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.columns import pick
from fieldweave.llm.packing import slices
from fieldweave.llm.storage import stage

#: The runs that are words, and what ends one.
RUN, NO_RUN = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Code points of a text read at once (a longer run stays whole).
STRETCH = 1 << 20
#: Distinct words a worker counts, and code points of them, before it passes the counts on.
HELD_WORDS, HELD_POINTS = 200_000, 8 << 20
#: Keys a bucket should hold, and keys a worker gathers before it passes blocks of them on.
BUCKET_KEYS, BLOCK_KEYS = 1 << 20, 1 << 21
#: The odd base of the polynomial hashes, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A key: its hash, the place of the deleted code point (-1: the whole word) and the word's number.
KEY = np.dtype([("key", "<u8"), ("place", "<i4"), ("word", "<i8")])


def altered(run: str, crc: int | None, every: int) -> str:
    """The run, without one code point if ``every`` divides the check sum of id and run; ``crc`` is that of the id."""
    if crc is None:
        return run
    h = zlib.crc32(run.encode(), crc)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def stretches(text: str):
    """Consecutive parts of a text that no run crosses."""
    at = 0
    while at < len(text):
        end = NO_RUN.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6) -> DataFrame:
    """word and n: occurrences, over all whole texts, of the lower-cased and altered runs of at least ``least`` code points."""

    def run(batches):
        held, points = Counter(), 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, 1):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    crc = None if doc is None else zlib.crc32(f"{doc}:".encode())
                    for part in stretches(text or ""):
                        for word, n in Counter(RUN.findall(part.translate(LOWER))).items():
                            word = altered(word, crc, every)
                            if len(word) >= least:
                                points += 0 if word in held else len(word)
                                held[word] += n
                    if len(held) > HELD_WORDS or points > HELD_POINTS:
                        yield flush()
                        held, points = Counter(), 0
        if held:
            yield flush()

    given = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("string"), F.col("text").cast("string"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashes(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words that stand end to end: the hash of each, and of each without the code point at each place.

    A word's hash is the sum of its code points times falling powers of BASE. Running sums over all words give every prefix's and suffix's
    by subtraction, so no word needs a loop of its own.
    """
    with np.errstate(over="ignore"):
        ends = np.cumsum(sizes)
        begin = ends - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(points)) - begin[of]
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(int(sizes.max(initial=0)), 1), BASE, np.uint64))])
        # Suffix weights: code point j of n has BASE**(n - 1 - j).
        term = (points.astype(np.uint64) + np.uint64(1)) * power[sizes[of] - 1 - place]
        total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        whole = total[ends] - total[begin]
        prefix = total[np.arange(len(points))] - total[begin[of]]
        suffix = total[ends[of]] - total[np.arange(len(points)) + 1]
        # A prefix keeps its weights less one power once a place behind it is gone: it is multiplied by the inverse of BASE.
        return whole, prefix * np.uint64(pow(int(BASE), -1, 1 << 64)) + suffix


def mixed(key: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits, so that leading bits deal evenly."""
    with np.errstate(over="ignore"):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return key ^ (key >> np.uint64(31))


def word_keys(words: list[str], numbers: np.ndarray) -> np.ndarray:
    """All keys of some words."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    whole, rest = hashes(points, sizes)
    out = np.empty(len(whole) + len(rest), KEY)
    ends = np.cumsum(sizes)
    out["key"] = mixed(np.concatenate([whole, rest]))
    out["place"] = np.concatenate([np.full(len(sizes), -1), np.arange(len(rest)) - np.repeat(ends - sizes, sizes)])
    out["word"] = np.concatenate([numbers, np.repeat(numbers, sizes)])
    return out


def pairs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that may be near, from the keys of one bucket: (a, b) once for each way they meet."""
    keys = keys[np.lexsort((keys["word"], keys["place"], keys["key"]))]
    key, place, word = keys["key"], keys["place"], keys["word"]
    left, right = [], []
    # Replacements: rows of one key and one place; each is paired with those 1, 2, ... rows on while the stretch lasts.
    same = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0)
    at, by = np.flatnonzero(same), 1
    while len(at):
        left.append(word[at])
        right.append(word[at + by])
        by += 1
        at = at[at + by < len(key)]
        at = at[(key[at] == key[at + by]) & (place[at] == place[at + by])]
    # Insertions: whole words come first among the rows of a key.
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    wholes = np.add.reduceat(place == -1, first) if len(key) else size
    for k in np.flatnonzero((wholes > 0) & (wholes < size)):
        longer = np.unique(word[first[k] + wholes[k] : first[k] + size[k]])
        for a in word[first[k] : first[k] + wholes[k]]:
            left.append(np.full(len(longer), a))
            right.append(longer)
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *left]), np.concatenate([nothing, *right])


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, b, both ways) of the numbers of words exactly one inserted, deleted or replaced code point apart, of a staged table of number and word."""
    keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    buckets = max(1, -(-keys // BUCKET_KEYS))

    def send(batches):
        held, size = [], 0

        def flush():
            keys = np.concatenate(held)
            # The bucket is the product's upper half: the key's place among equal ranges.
            bucket = ((keys["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            keys = keys[np.argsort(bucket, kind="stable")]
            counts = np.bincount(bucket, minlength=buckets)
            there, edges = np.flatnonzero(counts), np.cumsum(counts)
            parts = [keys[edges[b] - counts[b] : edges[b]].tobytes() for b in there]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            texts, numbers = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            # Words by runs of bounded total length; a longer word goes by itself.
            part = np.array(list(accumulate(map(len, texts))), np.int64) // (BLOCK_KEYS // 4)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    held.append(word_keys(texts[a:b], numbers[a:b]))
                    size += len(held[-1])
                    if size > BLOCK_KEYS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        a, b = pairs_of(np.frombuffer(b"".join(table.column("block").to_pylist()), KEY))
        return pa.table({"a": pa.array(np.concatenate([a, b]), pa.int64()), "b": pa.array(np.concatenate([b, a]), pa.int64())})

    blocks = words.select("number", "word").mapInArrow(send, "bucket long, block binary")
    met = blocks.groupBy("bucket").applyInArrow(meet, "a long, b long").where("a <> b").distinct()
    one, other = (words.select(F.col("number").alias(k), F.col("word").alias(f"word_{k}")) for k in "ab")
    # Verification on the strings themselves.
    return met.join(one, "a").join(other, "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    every: int = 199,
) -> DataFrame:
    """One row a word: word, form, root, n, n_near and form_n.

    Words are the runs of Latin letters of whole texts, with A-Z lower-cased and (where ``every`` divides the CRC-32 of ``<id>:<run>``) one code point
    deleted, of at least ``least_length`` code points and ``least_count`` occurrences (``n``). ``n_near`` counts the words exactly one code point
    inserted, deleted or replaced away. The ``form`` is the near word of largest n, the smallest in code-point order of equals, if it occurs at
    least ``ratio`` times as often, else null; ``form_n`` is its n. ``root`` is where following forms ends, the word itself without a form.

    Null and empty texts hold no words. Runs of rows without an id are not altered. Repeated rows count each time. Other columns are ignored; an empty table
    gives no rows. A run of any length is a word like others.
    """
    if ratio < 2 or least_count < 1:
        raise ValueError("a form occurs at least twice as often, and words at least once")
    counted = count_words(docs, id_col, text_col, every, least_length).where(F.col("n") >= least_count)
    words = stage(counted.withColumn("number", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words)
    near = pairs.join(words.select(F.col("number").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near", "b")).alias("best"))
    often = -F.col("best.less") >= F.col("n") * ratio
    when = lambda c: F.when(often, c)
    found = stage(
        words.join(best.withColumnRenamed("a", "number"), "number", "left").select(
            "number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            when(F.col("best.near")).alias("form"), when(-F.col("best.less")).alias("form_n"), when(F.col("best.b")).alias("to"),
        ),
        "forms",
    )
    return _with_roots(found, ratio).select("word", "form", "root", "n", "n_near", "form_n")


def _with_roots(found: DataFrame, ratio: int) -> DataFrame:
    """Follow ``to`` to the end. Every step multiplies n, so paths are short; each round doubles what a path passes at once, over words with a form alone."""
    paths = found.where(F.col("to").isNotNull()).select("number", F.col("to").alias("end"))
    most = found.agg(F.max("form_n")).first()[0] or 0
    steps = next(k for k in range(64) if ratio**k > most)
    while steps > 1:
        on = paths.select(F.col("number").alias("end"), F.col("end").alias("next"))
        paths = stage(paths.join(on, "end", "left").select("number", F.coalesce("next", "end").alias("end")), "paths")
        steps = -(-steps // 2)
    ends = paths.join(found.select(F.col("number").alias("end"), F.col("word").alias("root")), "end").select("number", "root")
    return found.join(ends, "number", "left").withColumn("root", F.coalesce("root", "word"))
