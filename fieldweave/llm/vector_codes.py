"""Product codes of vectors: Lloyd's rounds for the parts of integer vectors, with Hamerly's bounds.

Every vector is cut into parts, each with a codebook of its own. The state of a vector (its integers, and for every part
the assigned entry, an upper bound of the distance to it and a lower bound of the distance to any other) is a staged table, so a round
is one map over it that survives lost executors: bounds move by as much as the entries did, and a part is compared with
all entries only where its upper bound is not strictly below the lower one (or half the way from its entry to the nearest
other), so ties always reach the integer comparison, which takes the lower index. Each task adds its sums by entry as one more row of the
same table; Spark adds those up, and the driver sees the codebooks alone.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.columns import pick
from fieldweave.llm.storage import drop, stage, stage_at

#: Components compared at once, which bounds a worker's memory.
AT_ONCE = 1 << 21
#: Distinct labels, and bytes of them, whose sums may be broadcast; more are joined over salted keys.
BROADCAST_LABELS, BROADCAST_BYTES = 100_000, 4 << 20
#: Pieces of a hot label in that join.
SALTS = 32
#: Relative room for rounding that keeps floating bounds on the safe side.
ROOM = 2.0**-50


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` (entry, component) of every part, as integers of 64 bits."""

    entries: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def part_edges(dim: int, parts: int) -> list[int]:
    """Where consecutive parts begin and end: equal, or the first ones longer by one where ``parts`` does not divide ``dim``."""
    size, longer = divmod(dim, parts)
    return [k * size + min(k, longer) for k in range(parts + 1)]


def most(dim: int) -> int:
    """The largest integer component for which every squared distance fits 63 bits."""
    return math.isqrt((2**63 - 1) // max(dim, 1)) // 2


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (row, entry)."""
    return ((x[:, None, :] - book[None]) ** 2).sum(2)


class Step:
    """One assignment of all parts of a batch, given the codebooks and how far they moved since the state was written."""

    def __init__(self, books: Codebooks, before: Codebooks | None):
        self.books, self.parts = books.entries, len(books.entries)
        self.edges = np.concatenate([[0], np.cumsum([b.shape[1] for b in self.books])]).tolist()
        self.first = before is None
        self.moved = [np.zeros(len(b)) if self.first else np.sqrt(((b - o) ** 2).sum(1)) * (1 + ROOM) for b, o in zip(self.books, before.entries if before else self.books)]
        self.others, self.half = [], []
        for book, moved in zip(self.books, self.moved):
            # The farthest move of any other entry, and half the way to the nearest other entry.
            self.others.append(np.array([np.delete(moved, k).max(initial=0.0) for k in range(len(book))]))
            apart = np.sqrt(distances(book, book).astype(float))
            np.fill_diagonal(apart, np.inf)
            self.half.append(apart.min(1) / 2 * (1 - ROOM))

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring ``at``, ``upper`` and ``lower`` (row, part) up to date in place; returns how many parts were compared with all entries."""
        scanned = 0
        for p, book in enumerate(self.books):
            mine = x[:, self.edges[p] : self.edges[p + 1]]
            if self.first:
                rows = np.arange(len(x))
            else:
                a = at[:, p]
                upper[:, p] = (upper[:, p] + self.moved[p][a]) * (1 + ROOM)
                lower[:, p] = (lower[:, p] - self.others[p][a]) * (1 - ROOM)
                bound = np.maximum(lower[:, p], self.half[p][a])
                rows = np.flatnonzero(~(upper[:, p] < bound))
                # The true distance may already be below the bound.
                upper[rows, p] = np.sqrt(((mine[rows] - book[a[rows]]) ** 2).sum(1)) * (1 + ROOM)
                rows = rows[~(upper[rows, p] < bound[rows])]
            for k in range(0, len(rows), max(1, AT_ONCE // max(1, book.size))):
                r = rows[k : k + max(1, AT_ONCE // max(1, book.size))]
                d = distances(mine[r], book)
                best = d.argmin(1)
                least = d[np.arange(len(r)), best]
                d[np.arange(len(r)), best] = np.iinfo(np.int64).max
                at[r, p], upper[r, p] = best, np.sqrt(least) * (1 + ROOM)
                lower[r, p] = np.sqrt(d.min(1)) * (1 - ROOM) if len(book) > 1 else np.inf
            scanned += len(rows)
        return scanned

    def sums(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By part and entry: the sums of its parts' components and their number, end to end."""
        out = []
        for p, book in enumerate(self.books):
            total = np.zeros((len(book), book.shape[1] + 1), np.int64)
            np.add.at(total, at[:, p], np.concatenate([x[:, self.edges[p] : self.edges[p + 1]], np.ones((len(x), 1), np.int64)], 1))
            out.append(total.ravel())
        return np.concatenate(out)

    def errors(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over parts."""
        return sum(((x[:, self.edges[p] : self.edges[p + 1]] - book[at[:, p]]) ** 2).sum(1) for p, book in enumerate(self.books))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Rows of packed numbers as a writable array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _packed(values: np.ndarray, kind) -> pa.Array:
    values = np.ascontiguousarray(values, kind)
    return pa.array([row.tobytes() for row in values], pa.binary())


def integer_vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, dim, x) of the whole vectors of (vec_id, label, x): components as floor(scale * x), packed in 64 bits."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            values, edges = column.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            x = np.floor(values.to_numpy(zero_copy_only=False).astype(float) * scale)
            size = np.diff(edges)
            with np.errstate(invalid="ignore"):
                # A null component came as NaN, and fails the comparison as NaN and infinities do.
                bad = ~(np.abs(x) <= np.repeat(np.array([most(int(n)) for n in size], float), size))
            bad = np.concatenate([[0], np.cumsum(bad)])
            keep = (bad[edges[1:]] == bad[edges[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
            whole = np.where(np.repeat(keep, size), x, 0).astype("<i8")
            packed = pa.array([whole[a:b].tobytes() for a, b, k in zip(edges, edges[1:], keep) if k], pa.binary())
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(size[keep], pa.int32()), packed], names=["vec_id", "label", "dim", "x"])

    return df.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, x binary")


def quantize(
    df: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    counts: list[int] | None = None,
) -> tuple[DataFrame, Codebooks]:
    """Codes and errors of all whole vectors, and the codebooks.

    Columns: vec_id, label, codes (array of the assigned entry of every part), error (squared distance to the assigned
    entries, in scaled integers). Components become floor(scale * x). Codebooks start as the parts of the ``entries`` vectors of smallest ids
    (null ids come last, equal ids in order of their vectors), fewer where there are fewer vectors. Each of ``rounds`` rounds assigns each part to
    its nearest entry, the lower index of equally near ones, and replaces every entry by the floor of the mean of its parts; entries without parts stay. Then
    parts are assigned once more.

    Dropped: null vectors, vectors with null, NaN or infinite components, vectors whose length is not that of the first start entry, and
    those with components so large (``most``: beyond 1.8e8 for 64 components) that squared distances exceed 63 bits.
    Repeated rows and ids stay rows of their own. A length that ``parts`` does not divide makes the first parts longer by one. An empty table gives
    no rows and codebooks without entries. Other columns are ignored. ``counts``, if given, receives the number of full comparisons of each round.
    """
    given = pick(df, vec_id=id_col, x=vector_col, label=label_col).withColumn("x", F.col("x").cast("array<double>"))
    whole, path = stage_at(integer_vectors(given, scale), "vectors")
    # Of equal ids the vectors decide, in order of their components; only rows that share one of the smallest ids are compared by them.
    begin = _smallest(whole, entries)
    if begin and any(r.dim != begin[0].dim for r in begin):
        begin = _smallest(whole.where(F.col("dim") == begin[0].dim), entries)
    if not begin:
        nothing = whole.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return nothing, Codebooks((np.zeros((0, 0), np.int64),) * parts)
    dim = begin[0].dim
    edges, start = part_edges(dim, parts), np.array([np.frombuffer(r.x, "<i8") for r in begin], np.int64).reshape(len(begin), dim)
    books = Codebooks(tuple(start[:, a:b] for a, b in zip(edges, edges[1:])))
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    table, before = whole.where(F.col("dim") == dim), None
    for number in range(rounds + 1):
        staged = _assigned(table, kinds, books, before, dim, last=number == rounds)
        now, where = stage_at(staged, "codes")
        drop(path)
        if number == rounds:
            return now.select("vec_id", "label", "codes", "error"), books
        sums = now.where(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("k", "n"))
        sums = {r.k: int(r.n) for r in sums.groupBy("k").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()}
        if counts is not None:
            counts.append(sums[max(sums)])
        table, path, before, books = now.where(F.col("sums").isNull()), where, books, _means(books, sums)
    raise AssertionError


def _smallest(whole: DataFrame, entries: int) -> list:
    """The rows (dim, x) of the smallest ids, nulls last; of equal ids in order of their vectors."""
    order = F.col("vec_id").asc_nulls_last()
    last = whole.select("vec_id").orderBy(order).limit(entries).collect()
    if not last:
        return []
    # All rows of the ids taken, distinct ones with their number: repeated rows without end are one row here.
    ids = [r.vec_id for r in last if r.vec_id is not None]
    among = (F.col("vec_id") <= F.lit(max(ids)) if ids else F.lit(False)) | (F.col("vec_id").isNull() & F.lit(len(ids) < len(last)))
    rows = whole.where(among).groupBy("vec_id", "dim", "x").agg(F.count("*").alias("n"))
    # Components in order: their bytes, highest first, with the sign turned.
    tell = F.udf(lambda x: (np.frombuffer(x, "<i8").astype(">u8") ^ np.uint64(1 << 63)).astype(">u8").tobytes(), "binary")
    found = rows.withColumn("order", tell("x")).orderBy(order, "order").limit(entries).collect()
    return [r for r in found for _ in range(r.n)][:entries]


def _means(books: Codebooks, sums: dict[int, int]) -> Codebooks:
    """Every entry replaced by the floor of its parts' mean."""
    out, k = [], 0
    for book in books.entries:
        new, width = book.copy(), book.shape[1]
        for e in range(len(book)):
            if count := sums[k + width]:
                new[e] = [sums[k + c] // count for c in range(width)]
            k += width + 1
        out.append(new)
    return Codebooks(tuple(out))


def _assigned(table: DataFrame, kinds: dict[str, str], books: Codebooks, before: Codebooks | None, dim: int, last: bool) -> DataFrame:
    """The state after one assignment, and from every task a row of sums; or, at the ``last``, codes and errors."""
    parts, first = len(books.entries), before is None

    def run(batches):
        step, total, scanned, kind_of = Step(books, before), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, labels = batch.column(0), batch.column(1)
            x = _matrix(batch.column(2), dim, "<i8")
            if first:
                at, upper, lower = np.zeros((n, parts), np.uint8 if len(books.entries[0]) <= 256 else np.int32), np.zeros((n, parts)), np.zeros((n, parts))
            else:
                at = _matrix(batch.column(3), parts, "<u1" if len(books.entries[0]) <= 256 else "<i4")
                upper, lower = (_matrix(batch.column(k), parts, "<f8") for k in (4, 5))
            scanned += step.assign(x, at, upper, lower)
            if last:
                codes = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * parts, pa.array(at.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(step.errors(x, at), pa.int64())], names=["vec_id", "label", "codes", "error"])
                continue
            total, kind_of = total + step.sums(x, at), (ids.type, labels.type)
            state = [_packed(x, "<i8"), _packed(at, at.dtype), _packed(upper, "<f8"), _packed(lower, "<f8")]
            yield pa.RecordBatch.from_arrays([ids, labels, *state, pa.nulls(n, pa.list_(pa.int64()))], names=["vec_id", "label", "x", "at", "upper", "lower", "sums"])
        if kind_of:
            row = [pa.nulls(1, kind_of[0]), pa.nulls(1, kind_of[1]), *[pa.nulls(1, pa.binary())] * 4, pa.array([[*total.tolist(), scanned]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, names=["vec_id", "label", "x", "at", "upper", "lower", "sums"])

    own = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    table = table.select("vec_id", "label", "x") if first else table.select("vec_id", "label", "x", "at", "upper", "lower")
    return table.mapInArrow(run, own + ("codes array<int>, error long" if last else "x binary, at binary, upper binary, lower binary, sums array<long>"))


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the errors summed over equal labels (nulls together; null beyond 64 bits). Sums are broadcast up to a checked size, else joined over salted labels."""
    sums = stage(codes.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(20,0))) as long)").alias("label_error")), "label_errors")
    size = sums.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("label").cast("string"))).alias("bytes")).first()
    if size.n <= BROADCAST_LABELS and (size.bytes or 0) <= BROADCAST_BYTES:
        right = F.broadcast(sums.withColumnRenamed("label", "of"))
        return codes.join(right, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    right = sums.withColumnRenamed("label", "of").withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "error"), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("with")), "left").drop("of", "with", "salt")


def compress(df: DataFrame, **how) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every whole vector; as ``quantize``."""
    codes, books = quantize(df, **how)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return label_errors(codes).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
