"""SimHash near-dedup through an inverted index on fingerprint bytes.

Fingerprints that differ in at most ``k`` bits differ in at most ``k`` of their eight bytes,
so they share at least 8 - k positional bytes (five for k = 3). Of any five positions, three
lie in one half of the fingerprint, so posting lists are kept for the four byte triples
of each half: eight lists a fingerprint. Members of a list tally their shared positional bytes,
pairs with at least 8 - k matches are retained and verified bit by bit. A list that is too long
for one comparison is divided: its pairs must share two more of the other five bytes, which
gives ten narrower lists, and these by further bytes, until every list is short or its members
differ in so few bits that neighbours are looked up instead of compared.

Several fingerprints a text (``tables``), each indexed alike and linked if any of them is near, find
texts that are further apart. A list yields the edges of a spanning forest of its verified links, not every pair, so output
is linear in the list's length while no two linked fingerprints are separated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.graph import components
from fieldweave.llm.packing import slices
from fieldweave.llm.storage import stage

#: A longer posting list is divided by further bytes.
LONG_LIST = 1024
HALVES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
#: Rows of shingle bits counted at once, few enough for counts of 16 bits.
_ROWS_AT_ONCE = 1 << 12


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of the whole sequence if it has fewer words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(tokens) - words + 1) if tokens else 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, seed)] * n, np.uint64)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)])
    begins, ends = starts[:n].tolist(), (starts[words : words + n] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends)), np.uint64, n)


def _mixed(hashes: np.ndarray, tables: int) -> np.ndarray:
    """A row for each hash: itself, and another hash of the same shingle for each further table."""
    out = np.empty((len(hashes), tables), np.uint64)
    out[:, 0] = hashes
    x = hashes[:, None] + np.arange(1, tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    out[:, 1:] = x ^ x >> np.uint64(31)
    return out


def fingerprint(text: str | None, words: int = 3, tables: int = 1) -> list[int]:
    """The SimHashes of a text's word shingles. A text without words has zeros."""
    return bits_of(shingle_hashes(text, words), tables)


def bits_of(hashes: np.ndarray, tables: int) -> list[int]:
    """SimHashes of shingles: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64 * tables, np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = _mixed(hashes[at : at + _ROWS_AT_ONCE], tables).astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, tables: int) -> DataFrame:
    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, 1)):
            fps = np.array([fingerprint(t.as_py(), words, tables) for t in batch.column(1)], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "fps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fps array<long>")


def _postings(source: DataFrame, combos: list[tuple[int, ...]]) -> DataFrame:
    """(t, n, bytes, fp) for each combination of positions of each fingerprint (t, fp)."""
    lists = []
    for n, combo in enumerate(combos):
        mask = sum(0xFF << (8 * p) for p in combo)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        lists.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes")))
    return source.select("t", "fp", F.explode(F.array(*lists)).alias("k")).select("t", F.col("k.n").alias("n"), F.col("k.bytes").alias("bytes"), "fp")


def linked(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among one list's distinct fingerprints, each to its tree's first member."""
    root = np.arange(len(fps))
    least = 8 - max_bits
    as_bytes = fps.astype("<u8").view(np.uint8).reshape(-1, 8)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 21) // max(1, len(fps)))
    for at in range(0, len(fps), step):
        block = slice(at, at + step)
        tally = (as_bytes[block, None, :] == as_bytes[None, :, :]).sum(axis=2, dtype=np.uint8) if len(fps) <= LONG_LIST else None
        apart = np.bitwise_count(fps[block, None] ^ fps[None, :]) <= max_bits
        a, b = np.nonzero(apart if tally is None else (tally >= least) & apart)
        a += at
        for i, j in zip(a[a < b].tolist(), b[a < b].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(int(fps[find(i)]), int(fps[i])) for i in range(len(fps)) if find(i) != i]


def _neighbours(fps: np.ndarray, free: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """As ``linked``, for a long list whose members differ only in the bits ``free``: looks up each member's neighbours, so time is linear in the list."""
    fps = np.sort(fps)
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bits = [np.uint64(1) << np.uint64(b) for b in np.flatnonzero(free)]
    for n in range(1, max_bits + 1):
        for flip in combinations(bits, n):
            other = fps ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            for i in np.flatnonzero((fps[at] == other) & (fps < other)).tolist():
                x, y = find(i), find(int(at[i]))
                if x != y:
                    root[max(x, y)] = min(x, y)
    return [(int(fps[find(i)]), int(fps[i])) for i in range(len(fps)) if find(i) != i]


def _links_of_list(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    if len(fps) <= 4 * LONG_LIST:
        return linked(fps, max_bits)
    varied = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = np.array([varied >> b & 1 for b in range(64)], bool)
    return _neighbours(fps, free, max_bits)


def _compare(postings: DataFrame, max_bits: int) -> DataFrame:
    """Links (t, a, b) of every list; lists come whole to one task each, sorted, and are bounded by the caller."""

    def run(batches):
        held_key, held = None, []

        def edges():
            return [(held_key[0], *e) for e in _links_of_list(np.concatenate(held).view(np.uint64), max_bits)] if sum(map(len, held)) > 1 else []

        for batch in batches:
            t, n, key, fp = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (key[1:] != key[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if a == b:
                    continue
                this = (int(t[a]), int(n[a]), int(key[a]))
                if this != held_key:
                    out += edges()
                    held_key, held = this, []
                held.append(fp[a:b])
            if out:
                yield _edge_batch(out)
        out = edges()
        if out:
            yield _edge_batch(out)

    return postings.select("t", "n", "bytes", "fp").repartition("t", "n", "bytes").sortWithinPartitions("t", "n", "bytes").mapInArrow(run, "t int, a long, b long")


def _edge_batch(edges: list[tuple[int, int, int]]) -> pa.RecordBatch:
    t, a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))], names=["t", "a", "b"])


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (t, a, b) between the distinct fingerprints (t, fp) of each table, whose components are those of all links of at most ``max_bits`` differing bits."""
    # Three bytes of a half first; a long list needs two more of the remaining five.
    first, key = _postings(distinct, HALVES), ["t", "n", "bytes"]
    sizes = stage(first.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")
    found = _compare(first.join(sizes.where(F.col("size") <= LONG_LIST).drop("size"), key, "left_semi"), max_bits)
    long = sizes.where(F.col("size") > LONG_LIST).drop("size")
    if not long.isEmpty():
        members = first.join(long, key, "left_semi").select("t", "fp").distinct()
        narrow = _postings(members, list(combinations(range(8), 8 - max_bits)))
        held = narrow.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
        found = found.unionByName(_compare(narrow.join(held, key, "left_semi"), max_bits))
    return found.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, tables: int = 1) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Shingles are ``words`` lower-cased (A-Z) words; a text of fewer is one shingle, and an empty or null
    one has fingerprint zero, linked like any other. Texts are linked if the fingerprints of any of ``tables`` differ
    in at most ``max_bits`` (three at most); the first table's is shown. component_id is the smallest id reachable
    over links; ids that are null count only where a component has no other. Repeated rows get the
    same result each; other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits is at most three: beyond it no three bytes of a half need be alike")
    own = stage(fingerprints(docs, id_col, text_col, words, tables), "fingerprints")
    classes = stage(own.groupBy("fps").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    spread = classes.select("node", F.posexplode("fps").alias("t", "fp"))
    leads = stage(spread.groupBy("t", "fp").agg(F.min("node").alias("lead")), "leads")
    found = links(leads.select("t", "fp"), max_bits)
    named = lambda c: leads.select("t", F.col("fp").alias(c), F.col("lead").alias(f"of_{c}"))
    edges = found.join(named("a"), ["t", "a"]).join(named("b"), ["t", "b"]).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    if tables > 1:
        edges = edges.unionByName(spread.join(leads, ["t", "fp"]).where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    roots = components(stage(edges.distinct(), "links"))
    rooted = classes.join(roots, "node", "left").select("fps", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named_fps = rooted.join(least, "root").select("fps", "component_id")
    return own.join(named_fps, "fps").select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")
