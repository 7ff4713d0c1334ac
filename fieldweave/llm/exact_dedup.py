"""Exact deduplication with mergeable counting quotient filters.

Every partition of the corpus builds counting quotient filters over the leading bits of its texts' 64-bit
fingerprints, as many bits as the corpus's size asks for. A fingerprint's high bits are its quotient, which names a slot, its
low bits the remainder, kept packed in that slot or the next free one; three bits a slot (occupied, continuation, shifted) tell
which run an entry belongs to, and a count follows its remainder within the run. Filters
are cut into segments of the fingerprint space; those of one segment are read back as sorted runs, whatever their sizes, and merged
without loss, adding counts. Fingerprints counted more
than once route their documents to byte verification, which groups the whole normalised
texts; fingerprints that turn out to hold different texts are separated there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.packing import slices
from fieldweave.llm.storage import stage

_SPACE = b" \t\n\r\x0b\x0c"
#: Fingerprints a merged segment should hold at least, and those of one partition in it.
SEGMENT_TARGET, SEGMENT_LEAST = 1 << 14, 64
#: Bits of a fingerprint in the filters beyond those that number the corpus's rows: one row in about a thousand is routed without need.
SPARE_BITS = 10
#: Least bits of a slot's remainder, in which the number of a count's digits fits.
LEAST_WIDTH = 5
#: At most so many repeated fingerprints are sent to tasks as a sorted array (8 bytes each); beyond it they are joined.
BROADCAST_FINGERPRINTS = 1 << 21


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(None, _SPACE)


def _fingerprints(bodies: list[bytes], bits: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b) for b in bodies], np.uint64) >> np.uint64(64 - bits)


def _digest(bits: int):
    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            bodies = [normalise(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_fingerprints(bodies, bits).view(np.int64)), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())],
                names=["doc_id", "fp", "points", "text_sha256"],
            )

    return run


class QuotientFilter:
    """A counting quotient filter of ``bits``-bit values, as bytes: three bits and a packed remainder for each slot."""

    def __init__(self, bits: int, quotient_bits: int, slots: int, flags: bytes, remainders: bytes):
        self.bits, self.quotient_bits, self.slots, self.flags, self.remainders = bits, quotient_bits, slots, flags, remainders

    @staticmethod
    def build(values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """Of sorted distinct values and how often each occurs."""
        # Filters are built and read in order, never probed, so they may be full: slots go on past the last quotient.
        q_bits = min(bits - 1, max(1, len(values).bit_length() - 1))
        r_bits = bits - q_bits
        width = max(LEAST_WIDTH, r_bits)
        quotients, remainders = (values >> np.uint64(r_bits)).astype(np.int64), values & np.uint64((1 << r_bits) - 1)
        many = np.flatnonzero(counts > 1)
        if len(many):
            # A remainder that stands twice has a count: the number of its digits, then count - 2 in digits of a remainder's size.
            extra = [[int(remainders[i]), *_digits(int(counts[i]) - 2, width)] for i in many]
            sizes = np.ones(len(values), np.int64)
            sizes[many] += [len(x) for x in extra]
            starts = np.cumsum(sizes) - sizes
            wide = np.zeros(int(sizes.sum()), np.uint64)
            wide[starts] = remainders
            for i, x in zip(many, extra):
                wide[starts[i] + 1 : starts[i] + 1 + len(x)] = x
            quotients, remainders = np.repeat(quotients, sizes), wide
        # Each entry lies in its quotient's slot or, if that is taken, after the entry before.
        order = np.arange(len(quotients))
        at = np.maximum.accumulate(quotients - order) + order if len(order) else order
        slots = max(1 << q_bits, int(at[-1]) + 1 if len(at) else 0)
        occupied, continuation, shifted = np.zeros((3, slots), bool)
        occupied[quotients] = True
        continuation[at[1:]] = quotients[1:] == quotients[:-1]
        shifted[at] = at != quotients
        held = np.zeros(slots, np.uint64)
        held[at] = remainders
        return QuotientFilter(bits, q_bits, slots, np.packbits(np.concatenate([occupied, continuation, shifted])).tobytes(), np.packbits((held[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1).tobytes())

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The values, sorted, and their counts."""
        r_bits = self.bits - self.quotient_bits
        width = max(LEAST_WIDTH, r_bits)
        occupied, continuation, shifted = np.unpackbits(np.frombuffer(self.flags, np.uint8), count=3 * self.slots).reshape(3, -1).astype(bool)
        bits = np.unpackbits(np.frombuffer(self.remainders, np.uint8), count=self.slots * width).reshape(-1, width)
        filled = np.flatnonzero(occupied | continuation | shifted)
        remainders = bits[filled].astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
        # The runs follow each other as the occupied quotients do.
        begins = ~continuation[filled]
        run = np.cumsum(begins) - 1
        values = (np.flatnonzero(occupied)[run].astype(np.uint64) << np.uint64(r_bits)) + remainders
        counts, keep = np.ones(len(values), np.int64), np.ones(len(values), bool)
        twice = np.flatnonzero((remainders[1:] == remainders[:-1]) & (run[1:] == run[:-1]))
        after = 0
        for i in twice.tolist():
            if i >= after:
                n = int(remainders[i + 2]) if i + 2 < len(run) and run[i + 2] == run[i] else 0
                counts[i] = 2 + sum(int(d) << (k * width) for k, d in enumerate(remainders[i + 3 : i + 3 + n].tolist()))
                after = i + 3 + n
                keep[i + 1 : after] = False
        return values[keep], counts[keep]


def _digits(n: int, bits: int) -> list[int]:
    """The number of digits of ``n`` to the base 2**bits, and the digits, lowest first."""
    out = []
    while n:
        out.append(n & (1 << bits) - 1)
        n >>= bits
    return [len(out), *out]


def merge_filters(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """All values of some filters, sorted, with their counts added; nothing is lost."""
    values, counts = (np.concatenate(x) for x in zip(*(f.entries() for f in filters)))
    # The parts are sorted runs, which a stable sort merges.
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


def segment_filters(values: np.ndarray, bits: int, segment_bits: int):
    """The filters of some values, one for each segment that holds any: (segment, filter)."""
    values, counts = np.unique(values, return_counts=True)
    low = bits - segment_bits
    segments = values >> np.uint64(low) if segment_bits else np.zeros(len(values), np.uint64)
    for k in np.unique(segments):
        a, b = np.searchsorted(segments, k, "left"), np.searchsorted(segments, k, "right")
        yield int(k), QuotientFilter.build(values[a:b] & np.uint64((1 << low) - 1), counts[a:b], low)


def repeated_prefixes(digests: DataFrame, bits: int, kept_bits: int, rows: int) -> DataFrame:
    """(prefix) of the leading ``kept_bits`` of fingerprints that occur more than once in all partitions together."""
    partitions = max(1, digests.rdd.getNumPartitions())
    segment_bits = min(kept_bits - 2, max(0, min((rows // SEGMENT_TARGET).bit_length(), (rows // partitions // SEGMENT_LEAST).bit_length() - 1)))
    low = kept_bits - segment_bits

    def build(batches):
        held = [b.column(0).to_numpy() for b in batches]
        parts = list(segment_filters(np.concatenate(held).view(np.uint64) >> np.uint64(bits - kept_bits), kept_bits, segment_bits)) if held else []
        columns = ([k for k, _ in parts], [f.quotient_bits for _, f in parts], [f.slots for _, f in parts], [f.flags for _, f in parts], [f.remainders for _, f in parts])
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["segment", "quotient_bits", "slots", "flags", "remainders"])

    def merge(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        values, counts = merge_filters([QuotientFilter(low, x["quotient_bits"], x["slots"], x["flags"], x["remainders"]) for x in parts])
        return pa.table({"prefix": pa.array((np.uint64(parts[0]["segment"]) << np.uint64(low) | values[counts > 1]).view(np.int64))})

    segments = digests.select("fp").mapInArrow(build, "segment long, quotient_bits int, slots int, flags binary, remainders binary")
    return segments.groupBy("segment").applyInArrow(merge, "prefix long")


def _prefix(bits: int, kept_bits: int) -> Column:
    return F.shiftrightunsigned("fp", bits - kept_bits)


def _routed(docs: DataFrame, repeated: DataFrame, bits: int, kept_bits: int) -> DataFrame:
    """(fp, doc_id, body) of the documents whose fingerprint's prefix is repeated."""
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.prefix for r in repeated.toLocalIterator()], np.int64))) if few else None

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole, 1)):
            bodies = [normalise(t.as_py()) for t in batch.column(1)]
            fp = _fingerprints(bodies, bits)
            kept = np.arange(len(fp))
            if wanted is not None:
                own = (fp >> np.uint64(bits - kept_bits)).view(np.int64)
                at = np.searchsorted(wanted.value, own)
                kept = np.flatnonzero(wanted.value[np.minimum(at, len(wanted.value) - 1)] == own) if len(wanted.value) else kept[:0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[kept].view(np.int64)), batch.column(0).take(pa.array(kept)), pa.array([bodies[i] for i in kept], pa.binary())], names=["fp", "doc_id", "body"])

    out = docs.mapInArrow(run, "fp long, doc_id long, body binary")
    return out if few else out.join(repeated, _prefix(bits, kept_bits) == repeated.prefix, "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text.

    Texts are equal when identical without the white space ``[\\x20\\x09-\\x0D]``; null counts
    as empty. Of equal texts the one with the most code points stays, then the smallest id. Rows
    that share an id are one document given more than once: each counts in group_size and
    all are kept if that id is. A null id loses ties to any other and equals only itself.
    Other columns are ignored; an empty table gives no rows.
    """
    bits = fingerprint_bits
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digests = stage(source.mapInArrow(_digest(bits), "doc_id long, fp long, points long, text_sha256 string"), "digests")
    rows = digests.count()
    kept_bits = min(bits, max(3, rows.bit_length() + SPARE_BITS))
    repeated = stage(repeated_prefixes(digests, bits, kept_bits, rows), "repeated")
    texts = _routed(source, repeated, bits, kept_bits).groupBy("fp", "body").agg(F.min("doc_id").alias("variant"))
    clashing = stage(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "clashing")
    if clashing.isEmpty():
        members = digests.withColumn("variant", F.lit(0).cast("long"))
    else:
        # Different texts under one fingerprint: each document takes the variant its bytes belong to.
        members = _apart(source, clashing, digests, bits)
    # Only what the filters found repeated is grouped; all other rows pass by.
    prefixes = F.broadcast(repeated) if repeated.count() <= BROADCAST_FINGERPRINTS else repeated
    candidates = members.join(prefixes, _prefix(bits, kept_bits) == repeated.prefix, "left_semi")
    best = candidates.groupBy("fp", "variant").agg(F.count(F.lit(1)).alias("group_size"), _smallest_of_longest().alias("keep")).where("group_size > 1")
    best = stage(best.select("fp", "variant", "group_size", F.col("keep.doc_id").alias("keep_id")), "groups")
    # Groups of at least a thousandth of the rows, of which there can be a thousand at most, are broadcast; the others are small and joined.
    large = F.col("group_size") >= max(1000, -(-rows // 1000))
    hot, rest = best.where(large), best.where(~large)
    key = ["fp", "variant"]
    joined = members.join(F.broadcast(hot), key).unionByName(members.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, "left"), allowMissingColumns=True)
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _smallest_of_longest() -> Column:
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")))


def _apart(source: DataFrame, clashing: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    bodies = _routed(source, clashing.withColumnRenamed("fp", "prefix"), bits, bits).withColumn("sha", F.sha2("body", 256))
    variants = bodies.groupBy("fp", "sha", "body").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("variant"))
    # Texts of one fingerprint and one sha256 are told apart by their bytes as well.
    named = bodies.join(variants, ["fp", "sha", "body"]).groupBy("doc_id", "fp", "sha").agg(F.min("variant").alias("variant"))
    return (
        digests.alias("d")
        .join(named.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.fp") == F.col("n.fp")) & (F.col("d.text_sha256") == F.col("n.sha")), "left")
        .select("d.*", F.coalesce("n.variant", F.lit(0).cast("long")).alias("v0"), F.col("n.sha").alias("s0"))
        .select("doc_id", "fp", "points", "text_sha256", F.when(F.col("s0").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("s0", "v0")).alias("variant"))
    )
