"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ten consecutive words (shorter items: the
whole item), grouped by their length. For each length a shift table over blocks of two
words tells how far the search may jump without missing an occurrence; a block that
ends a pattern has shift zero and selects the bucket of patterns that end in it, which
are compared with the text word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.packing import slices
from fieldweave.llm.storage import stage

#: A-Z become lower case; what can be no part of a word becomes a space. Bytes from 0x80 on belong to words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


#: Bytes of search tables for each word of the benchmark, counted generously.
BYTES_PER_WORD = 96


def split_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and the number of words of each."""
    folded = pa.array([(t or "").encode("utf-8", "replace").translate(_FOLD).strip() for t in texts], pa.binary()).cast(pa.string())
    split = pc.ascii_split_whitespace(folded)
    counts = np.where(pc.binary_length(folded).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0).astype(np.int64)
    flat = split.flatten()
    # An empty text splits into one empty word.
    return (flat.filter(pc.greater(pc.binary_length(flat), 0)) if (counts == 0).any() else flat), counts


class WuManber:
    """Search tables, as arrays, for patterns of one length: distinct rows of word numbers (below ``words``)."""

    def __init__(self, patterns: np.ndarray, words: int):
        self.patterns, self.words, self.m = patterns, words, patterns.shape[1]
        self.block = min(2, self.m)
        self.far = self.m - self.block + 1
        ends = np.arange(self.block - 1, self.m)
        keys = self._keys(patterns)
        shifts = np.broadcast_to(self.m - 1 - ends, keys.shape)
        order = np.lexsort((shifts.ravel(), keys.ravel()))
        flat = keys.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        #: The shift of each block of words that occurs in a pattern: the least over its places.
        self.keys, self.shift = flat[first], shifts.ravel()[order][first].astype(np.int32)
        #: Patterns by the block that ends them.
        self.by_end = np.argsort(keys[:, -1], kind="stable").astype(np.int32)
        self.ending = keys[self.by_end, -1]

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.int64) if self.block == 1 else rows[..., :-1].astype(np.int64) * self.words + rows[..., 1:]

    def search(self, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        """(text, start, pattern) of every occurrence in texts whose word numbers (-1: in no pattern) lie end to end."""
        m, lead = self.m, self.block - 1
        if len(ids) < m:
            return
        key = self._keys(ids)
        known = (ids >= 0) if self.block == 1 else (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        step = np.full(len(ids), self.far, np.int32)
        step[lead:] = np.where(known & (self.keys[at] == key), self.shift[at], self.far)
        stops = np.flatnonzero(step == 0)
        steps = None
        for text in np.unique(np.searchsorted(ends, stops, "right")).tolist():
            steps = step.tolist() if steps is None else steps
            end = int(ends[text])
            at = end - int(counts[text]) + m - 1
            while at < end:
                if steps[at]:
                    at += steps[at]
                    continue
                # The block selects the patterns that end in it, which are compared word by word.
                a, b = np.searchsorted(self.ending, key[at - lead], "left"), np.searchsorted(self.ending, key[at - lead], "right")
                window, start = ids[at - m + 1 : at + 1], at - m + 1
                for p in self.by_end[a:b][(self.patterns[self.by_end[a:b]] == window).all(1)].tolist():
                    yield text, start, p
                at += 1


class Benchmark:
    """Search tables of one block of the benchmark: a vocabulary, and tables for each pattern length."""

    def __init__(self, rows: list[tuple[str, str | None]], width: int):
        flat, counts = split_words([text for _, text in rows])
        coded = flat.dictionary_encode()
        self.vocabulary, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.names = np.array([item for item, _ in rows], object)
        starts, self.tables = np.cumsum(counts) - counts, []
        lengths = np.minimum(counts, width)
        for m in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == m)
            windows = counts[own] - m + 1
            item = np.repeat(own, windows)
            at = np.repeat(starts[own], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            patterns, which = np.unique(ids.astype(np.int32)[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0)
            # The items that hold each pattern, end to end.
            self.tables.append((WuManber(patterns, max(1, len(self.vocabulary))), np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1]))

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """The number of words of each text, for each word whether it is hit, and the items that occur by text."""
        flat, counts = split_words(texts)
        hit, found = np.zeros(len(flat), bool), {}
        if len(flat) and len(self.vocabulary):
            coded = flat.dictionary_encode()
            ids = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
            ends = np.cumsum(counts)
            for table, first, items in self.tables:
                for text, start, p in table.search(ids, ends, counts):
                    hit[start : start + table.m] = True
                    found.setdefault(text, set()).update(self.names[items[first[p] : first[p + 1]]])
        return counts, hit, found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    table_bytes: int = 64 << 20,
    carry: bool = False,
) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, and the items that occur.

    The benchmark's words are counted first, at BYTES_PER_WORD bytes of search tables each. Up to ``table_bytes`` they are one set of
    tables, sent to every task; the documents are then only mapped over. A larger one is
    cut into blocks of that size, one at a time built, sent and searched for over all documents, and the hits of
    the blocks are merged by document.

    Null and empty texts have no words. Items that are null or have no word match
    nothing; a null item id is written as ``null``. Rows repeated in ``docs`` appear as often
    as they come. Other columns are ignored, unless ``carry`` asks for all columns of ``docs`` beside the
    report, where a column named as one of the report's gives way to it. An empty benchmark hits nothing.
    """
    if carry:
        return _carried(docs, benchmark, width, id_col, text_col, item_col, table_bytes)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, text_col)
    blocks = _blocks(items, table_bytes)
    if blocks == 1:
        report = _report(_tables(docs.sparkSession, items, width))

        def run(batches):
            for batch in (b for whole in batches for b in slices(whole, 1)):
                yield pa.RecordBatch.from_arrays([batch.column(0), *report(batch.column(1))], names=["doc_id", *_REPORTED])

        return source.mapInArrow(run, _REPORT)
    return _in_blocks(source.withColumn("row_key", _row_key(F.col("doc_id"), F.col("text"))), items, width, blocks).drop("row_key")


def _row_key(doc_id, text):
    return F.sha2(F.to_json(F.struct(doc_id.alias("doc_id"), text.alias("text"))), 256)


def _in_blocks(source: DataFrame, items: DataFrame, width: int, blocks: int) -> DataFrame:
    """The report of each row (doc_id, text, row_key) and its key, by a search for each block of the benchmark."""
    rows, keyed = None, source.dropDuplicates(["row_key"])
    for k in range(blocks):
        tables = _tables(source.sparkSession, items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k), width)
        # Written before the next block is built, so the driver and the workers hold one block at a time.
        found = stage(keyed.mapInArrow(_hits(tables), "row_key string, hits array<int>, items array<string>"), "hits")
        tables.destroy()
        rows = found if rows is None else rows.unionByName(found)
    merged = rows.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = source.mapInArrow(_count, "doc_id long, row_key string, n_words long")
    return counted.join(merged, "row_key", "left").select(
        "row_key",
        "doc_id",
        "n_words",
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce(F.size("hits"), F.lit(0)) > 0).alias("contaminated"),
    )


def _carried(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, table_bytes: int) -> DataFrame:
    """The report beside all columns of ``docs``: the text is reported on in place, with no join where one set of tables holds the benchmark."""
    items = _items(benchmark, item_col, text_col)
    names = [c for c in docs.columns if c.lower() not in _REPORTED]
    blocks = _blocks(items, table_bytes)
    if blocks > 1:
        # A report depends on the text alone, so each text is searched once, and rows find theirs by it, whatever their ids.
        text = F.col(f"`{text_col}`").cast("string")
        key = _row_key(F.lit(None).cast("long"), text)
        texts = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), key.alias("row_key")).dropDuplicates(["row_key"])
        report = _in_blocks(texts, items, width, blocks).drop("doc_id").withColumnRenamed("row_key", "report key")
        own = docs.select(*[F.col(f"`{c}`") for c in names], key.alias("own key"))
        return own.join(report, F.col("own key") == F.col("report key")).drop("own key", "report key")
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    report = _report(_tables(docs.sparkSession, items, width))
    text_at = names.index(text_col)

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, text_at)):
            yield pa.RecordBatch.from_arrays([*batch.columns, *report(batch.column(text_at))], names=[*names, *_REPORTED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, fields + ", " + _REPORT.split(", ", 1)[1])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_REPORTED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _blocks(items: DataFrame, table_bytes: int) -> int:
    """Blocks of the benchmark whose tables stay within the bound; half as large as need be, as hashing deals items unevenly."""
    words = F.size(F.split(F.col("text"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    size = BYTES_PER_WORD * (items.agg(F.sum(words)).first()[0] or 0)
    return 1 if size <= table_bytes else -(-2 * size // table_bytes)


def _tables(spark, items: DataFrame, width: int):
    """Search tables of one block of the benchmark, whose size the caller has bounded."""
    return spark.sparkContext.broadcast(Benchmark([(r.item, r.text) for r in items.collect()], width))


def _report(tables):
    """The columns of the report on texts, of which there is a row for each text given."""

    def report(texts: pa.Array) -> list[pa.Array]:
        counts, hit, found = tables.value.search(texts.to_pylist())
        upto = np.concatenate([[0], hit.cumsum()])
        ends = np.cumsum(counts)
        n_hit = upto[ends] - upto[ends - counts]
        sha = [hashlib.sha256(",".join(sorted(found[k])).encode()).hexdigest() if k in found else EMPTY_SHA256 for k in range(len(counts))]
        columns = (counts, n_hit, [len(found.get(k, ())) for k in range(len(counts))], sha, n_hit > 0)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return [pa.array(c, k) for c, k in zip(columns, kinds)]

    return report


def _hits(tables):
    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, 1)):
            counts, hit, found = tables.value.search(batch.column(1).to_pylist())
            ends, keys = np.cumsum(counts), batch.column(2)
            out = [{"row_key": keys[k].as_py(), "hits": np.flatnonzero(hit[ends[k] - counts[k] : ends[k]]).tolist(), "items": sorted(items)} for k, items in found.items()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row_key", pa.string()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return run


def _count(batches):
    for batch in (b for whole in batches for b in slices(whole, 1)):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(split_words(batch.column(1).to_pylist())[1], pa.int64())], names=["doc_id", "row_key", "n_words"])
