"""Packing documents into fixed token sequences: concatenate and cut.

Pass one tokenises each input partition and records, beside every document, its
token offset inside that partition. Prefix sums over the partition totals (one number
a partition) turn these into offsets in one corpus-wide stream. Pass two is a map: each
document's span is cut at the multiples of ``max_len`` it crosses, giving its boundary
pieces. The remainder of the stream, shorter than one window, is cut into sequences
of power-of-two length, so no sequence needs padding.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.storage import stage

#: Distinct pre-tokens whose ids a worker remembers before it starts afresh.
CACHE_PIECES = 500_000
#: Pre-tokens given to the tokenizer in one call.
ENCODE_AT_ONCE = 20_000
#: Bytes of text, or of ids, handled at once, which bounds a worker's memory.
SLICE_BYTES = 8 << 20


#: The settings of a tokenizer file whose texts may be encoded by chunks.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of plain letters, digits and signs, which normalisation only lower-cases.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: The tokenizer's own pre-token pattern, for plain chunks in lower case.
_PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


class _Index(dict):
    """Numbers keys as they first come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Ragged:
    """Rows of ids of different lengths, kept end to end."""

    def __init__(self):
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def extend(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, counts = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``."""
    ends = np.concatenate([[0], np.cumsum(values)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(lengths)])])


def _by_chunks(settings: dict) -> bool:
    """Whether no pre-token crosses ASCII white space, and pre-tokens are those of ``_PIECES``."""
    steps = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = steps[0] if len(steps) == 2 else {}
    whole = (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
    bytes_ = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return whole and bytes_ and (settings["normalizer"] or {}).get("normalizers") == _NORMALIZERS and not settings["post_processor"]


class ChunkEncoder:
    """Token ids of whole texts by way of their white-space-delimited chunks.

    No pre-token of the tokenizer crosses ASCII white space, so a text's ids are the
    concatenation of its chunks' ids; a tokenizer file of other settings encodes whole texts. Arrow finds the distinct chunks of a slice of texts and cuts the plain
    ones into pre-tokens, whose ids are remembered. All other chunks pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = _by_chunks(json.loads(self.tokenizer.to_str()))
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.pieces, self.piece_ids = _Index(), _Ragged()

    def _learn(self, words: list[str]) -> None:
        """Encode pre-tokens not seen before."""
        for at in range(0, len(words), ENCODE_AT_ONCE):
            part = words[at : at + ENCODE_AT_ONCE]
            got = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            self.piece_ids.extend(np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))

    def _chunk_ids(self, chunks: pa.Array) -> tuple[_Ragged, np.ndarray]:
        """Ids of distinct chunks, and the row of each among them."""
        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _PIECES, r"\1 ")))
        coded = parts.flatten().dictionary_encode()
        own, known = coded.dictionary.to_pylist(), len(self.pieces)
        rows = np.fromiter(map(self.pieces.__getitem__, own), np.int64, len(own))
        if len(self.pieces) > known:
            self._learn(list(islice(self.pieces, known, None)))
        ids, counts = self.piece_ids.take(rows[coded.indices.to_numpy()])
        found = _Ragged()
        found.extend(ids, _sums(counts, pc.list_value_length(parts).to_numpy().astype(np.int64)))
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        slow = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks.take(pa.array(other)).to_pylist()]
        found.extend(np.array([i for x in slow for i in x], np.uint32), np.array([len(x) for x in slow], np.int64))
        place = np.empty(len(chunks), np.int64)
        place[np.flatnonzero(plain.to_numpy(zero_copy_only=False))] = np.arange(len(chunks) - len(other))
        place[other] = np.arange(len(chunks) - len(other), len(chunks))
        return found, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each."""
        if not self.chunked:
            ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)
        if len(self.pieces) > CACHE_PIECES:
            self.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        found, place = self._chunk_ids(coded.dictionary)
        ids, counts = found.take(place[coded.indices.to_numpy()])
        return ids, _sums(counts, words)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = SLICE_BYTES):
    """Consecutive parts of a batch whose texts come to about ``most_bytes`` (a longer text is a part by itself)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its partition, offset within that partition, token count and ids (little-endian 32 bit, the end id included)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, position = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, counts = encoder.encode(batch.column(1))
                ends = np.cumsum(counts)
                full = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                ends = np.cumsum(counts)
                packed = [full[e - n : e].tobytes() for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(position + ends - counts), pa.array(counts), pa.array(packed, pa.binary())],
                    names=["doc_id", "part", "part_start", "doc_tokens", "ids"],
                )
                position += int(counts.sum())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, part int, part_start long, doc_tokens long, ids binary"
    )


def layout(total: int, max_len: int) -> np.ndarray:
    """Starts of the tail's sequences: the last ``total % max_len`` ids in falling powers of two, then the end of the stream."""
    rest, at, cuts = total % max_len, total - total % max_len, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        cuts.append(at)
        at, rest = at + size, rest - size
    return np.array([*cuts, total], np.int64)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_len: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents laid out in sequences of at most ``max_len`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length and, on request, the piece's ids. Null and empty texts hold only the
    end id. Repeated rows are packed once each; a null id stays null. Other columns of
    ``docs`` are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    # One number for each partition of the scan, never one for each document.
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    total = sum(n for _, n in totals)
    starts = dict(zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()))
    offsets, full, tail = spark.sparkContext.broadcast(starts), total // max_len, layout(total, max_len)

    def place(g: int) -> tuple[int, int, int]:
        """Sequence of the id at ``g``, the sequence's start and its end."""
        if g < full * max_len:
            return g // max_len, g // max_len * max_len, (g // max_len + 1) * max_len
        k = int(np.searchsorted(tail, g, "right")) - 1
        return full + k, int(tail[k]), int(tail[k + 1])

    def run(batches):
        for whole in batches:
            for part in slices(whole, 4):
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids")}
                for row in part.to_pylist():
                    g, done = offsets.value[row["part"]] + row["part_start"], 0
                    while done < row["doc_tokens"]:
                        sequence, begin, end = place(g + done)
                        n = min(row["doc_tokens"] - done, end - g - done)
                        piece = row["ids"][4 * done : 4 * (done + n)]
                        for k, v in zip(out, (row["doc_id"], done, n, zlib.crc32(piece), row["doc_tokens"], sequence, g + done - begin, end - begin, piece)):
                            out[k].append(v)
                        done += n
                if not with_ids:
                    del out["ids"]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    return tokens.mapInArrow(run, schema + ", ids binary" * with_ids)
