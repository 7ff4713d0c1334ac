"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by the hash of their text, so equal texts lie together. A sample that
favours large records (bounded by a parameter) gives quantiles of the bytes as splitters, which
cut the key space into many small ranges of about equal size. Texts that alone overfill
a range are subdivided by record. A range whose exact total still comes to more than twice its share, as its
sample fell badly, is subdivided at splitters sampled inside it. Exact totals of all parts then place the cuts
between shards, so shards differ by no more than a small part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldweave.llm.storage import stage

#: The key space is looked up by the top bits of the key, then by the few splitters that share them.
_COARSE_BITS = 12


def _splitters(records: DataFrame, total: int, ranges: int, sample_size: int) -> DataFrame:
    """One row for each coarse cell of the key space: the rank of its first range and its splitters (at most ``ranges`` in all)."""
    unit = F.pmod(F.xxhash64(F.lit("sample"), "row", "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = records.where(unit < F.col("size") * F.lit(sample_size / max(total, 1))).select("key")
    # The sample is bounded by sample_size; its quantiles are the splitters.
    cuts = sample.withColumn("tile", F.ntile(ranges).over(W.orderBy("key"))).groupBy("tile").agg(F.max("key").alias("cut")).select("cut").distinct()
    cells = records.sparkSession.range(1 << _COARSE_BITS).select((F.col("id") - (1 << (_COARSE_BITS - 1))).alias("cell"))
    own = cuts.groupBy(_cell(F.col("cut")).alias("cell")).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    joined = cells.join(F.broadcast(own), "cell", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    before = F.coalesce(F.sum(F.size("cuts")).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.select("cell", "cuts", before.alias("before"))


def _subdivided(placed: DataFrame, target: int, sample_per_range: int) -> DataFrame:
    """``placed`` with ``part``, the records' part of their range: 0, but in overfull ranges, which are cut at quantiles of a sample of their own."""
    plain = placed.where("hot_key IS NULL")
    # Fewer than half as many ranges as there are can hold more than twice their share.
    overfull = plain.groupBy("range").agg(F.sum("size").alias("held")).where(F.col("held") > 2 * target)
    unit = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = plain.join(F.broadcast(overfull), "range").where(unit < F.col("size") * F.lit(sample_per_range / target)).select("range", "key", F.ceil(F.col("held") / target).alias("parts"))
    # In expectation sample_per_range keys for each share of bytes, so the windows and what is broadcast stay as small as the first sample.
    ranked = sample.withColumn("at", F.row_number().over(W.partitionBy("range").orderBy("key")) - 1).withColumn("drawn", F.count(F.lit(1)).over(W.partitionBy("range")))
    cuts = ranked.groupBy("range", F.floor(F.col("at") * F.col("parts") / F.col("drawn")).alias("tile")).agg(F.max("key").alias("cut"))
    own = cuts.groupBy("range").agg(F.collect_set("cut").alias("inner_cuts"))
    part = F.size(F.filter(F.coalesce("inner_cuts", F.array().cast("array<bigint>")), lambda c: c < F.col("key"))).cast("long")
    return placed.join(F.broadcast(own), "range", "left").withColumn("part", F.when(F.col("hot_key").isNull(), part).otherwise(F.lit(0).cast("long"))).drop("inner_cuts")


def _cell(key):
    return F.shiftright(key, 64 - _COARSE_BITS)


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    ranges: int = 1024,
    sample_per_range: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of every row.

    Size is the UTF-8 length of the text (null: 0) plus 1. Equal texts share a shard unless they
    overfill one of the ``ranges`` that the shards consist of. Repeated rows get a slot each; null ids are
    placed like any other; other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    raw = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
    )
    records = stage(raw.withColumn("row", F.monotonically_increasing_id()), "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    target = max(1, total // ranges)
    # Texts that overfill a range by themselves: fewer than ``ranges`` of them can exist.
    hot = records.groupBy("key").agg(F.sum("size").alias("own")).where(F.col("own") > target).select("key", F.ceil(F.col("own") / target).alias("pieces"))
    lookup = _splitters(records, total, ranges, ranges * sample_per_range)
    placed = (
        records.withColumn("cell", _cell(F.col("key")))
        .join(F.broadcast(lookup), "cell")
        .join(F.broadcast(hot), "key", "left")
        .select(
            "doc_id", "size", "text_crc32", "key",
            (F.col("before") + F.size(F.filter("cuts", lambda c: c < F.col("key")))).cast("long").alias("range"),
            F.when(F.col("pieces").isNull(), F.lit(None).cast("long")).otherwise(F.col("key")).alias("hot_key"),
            F.coalesce(F.pmod(F.xxhash64("row", F.lit("piece")), F.col("pieces")), F.lit(0)).cast("long").alias("piece"),
        )
    )
    bucket = ["range", "part", "hot_key", "piece"]
    placed = _subdivided(stage(placed, "placed"), target, sample_per_range)
    # Exact totals: one row a part or piece, fewer than four times ``ranges``.
    earlier = W.orderBy(*[F.col(c).asc_nulls_first() for c in bucket]).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*bucket).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    totals = totals.select(
        *[F.col(c).alias(f"of_{c}") for c in bucket],
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in bucket]
    running = placed.join(F.broadcast(totals), same[0] & same[1] & same[2] & same[3])
    inside = W.partitionBy(*bucket).orderBy("key", "doc_id")
    running = _running(running, bucket, inside)
    sharded = stage(running.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("start") * shards / F.lit(max(total, 1)))).cast("int")), "sharded")
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _running(placed: DataFrame, bucket: list[str], inside) -> DataFrame:
    """Each record's row and first byte in the whole order; a text that is not subdivided starts where its first record does."""
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = placed.select("*", (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"), (F.col("bytes_before") + F.sum("size").over(upto) - F.col("size")).alias("at"))
    group = W.partitionBy(*bucket, "key")
    return own.select("doc_id", "size", "text_crc32", "row", F.when(F.col("hot_key").isNull(), F.min("at").over(group)).otherwise(F.col("at")).alias("start"))
