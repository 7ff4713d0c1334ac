"""Byte-level BPE: token ids of whole texts, and texts of token ids.

Texts are cut into pre-tokens without a regular expression. Code points become symbols (their class, with what a rule must
know of the code points beside them), each symbol is a function from the state before it to the state after
it, and as functions compose associatively a scan gives the state at every code point of many texts at once: compositions
over blocks, a scan over the blocks, and the states inside each block. State and symbol tell where a pre-token
starts. The slices between starts are made distinct by Arrow; those not met before are merged pair by pair, and
remembered. Decoding looks the ids up in one table of all tokens' bytes by its offsets.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.columns import pick
from fieldweave.llm.packing import _Ragged, _sums, slices

#: Distinct pre-tokens, and bytes of them, that a worker remembers before it starts afresh.
CACHE_PIECES, CACHE_BYTES = 300_000, 16 << 20
#: Bytes of text, or of ids, handled at once; a longer text is handled by itself.
SLICE_BYTES = 2 << 20
#: Functions composed one after the other within a block of the scan.
BLOCK = 64

# The rules of the public pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
# Letters and numbers of Unicode 16 that this Python's tables may not hold yet.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

#: Symbols: letter, number, other, apostrophe of an ending of one or two letters, white space, and its last before other text: a blank, or another.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LAST_BLANK, LAST_SPACE = range(8)
#: Added to the symbol of a text's first code point, which starts a pre-token whatever went before.
FIRST = 8
#: States: at a start, in letters, in numbers, in other signs, in white space, after a blank that joins what follows, in an ending with one or two letters to come.
FREE, LETTERS, NUMBERS, OTHERS, SPACES, BLANK, ONE_MORE, TWO_MORE = range(8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for ranges, symbol in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE_SPACE, SPACE)):
        for a, b in ranges:
            out[a : b + 1] = symbol
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether the symbol starts a pre-token."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FREE, False
    if symbol == LAST_BLANK:
        return BLANK, True
    if symbol == LAST_SPACE:
        return FREE, True
    if symbol in (SHORT, LONG) and state not in (OTHERS, BLANK):
        return ONE_MORE if symbol == SHORT else TWO_MORE, True
    run = {LETTER: LETTERS, NUMBER: NUMBERS, SPACE: SPACES}.get(symbol, OTHERS)
    return run, state not in (run, BLANK)


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """By symbol and state: the state after, and whether a pre-token starts."""
    steps = [[_step(s if a < FIRST else FREE, a % FIRST) for s in range(8)] for a in range(2 * FIRST)]
    return np.array([[to for to, _ in row] for row in steps], np.uint8), np.array([[start for _, start in row] for row in steps])


def states_before(functions: np.ndarray, begin: int = FREE) -> np.ndarray:
    """The state before each of a sequence of functions (rows: the image of every state), by composition over blocks and a scan of the blocks."""
    n, states = functions.shape
    if n <= BLOCK:
        out, state = np.empty(n, np.uint8), begin
        for k in range(n):
            out[k], state = state, functions[k, state]
        return out
    blocks = -(-n // BLOCK)
    same = np.arange(states, dtype=np.uint8)
    laid = np.concatenate([functions, np.broadcast_to(same, (blocks * BLOCK - n, states))]).reshape(blocks, BLOCK * states)
    row = np.arange(blocks)[:, None]
    whole = np.broadcast_to(same, (blocks, states))
    for k in range(BLOCK):
        whole = laid[row, whole + np.int64(k * states)]
    out, state = np.empty((blocks, BLOCK), np.uint8), states_before(whole, begin)
    for k in range(BLOCK):
        out[:, k] = state
        state = laid[row[:, 0], state + np.int64(k * states)]
    return out.ravel()[:n]


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of the code points of texts that stand end to end; ``firsts`` marks the first of each."""
    out = classes()[points]
    n = len(points)
    if not n:
        return out
    # What follows within the same text: code points 0 and class SPACE stand for its end.
    after = lambda values, by, end: np.where(inside[by - 1], np.concatenate([values[by:], np.zeros(by, values.dtype)]), end)
    one = np.append(~firsts[1:], False)
    inside = (one, one & np.append(one[1:], False))
    space = out == SPACE
    last = space & (after(out, 1, SPACE) != SPACE)
    at = np.flatnonzero(points == ord("'"))
    nxt, second = after(points, 1, 0)[at], after(points, 2, 0)[at]
    out[at[np.isin(nxt, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
    for a, b in LONG_ENDINGS:
        out[at[(nxt == ord(a)) & (second == ord(b))]] = LONG
    out[last] = np.where(points[last] == ord(" "), LAST_BLANK, LAST_SPACE)
    return out + FIRST * firsts.astype(np.uint8)


def starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token."""
    to, start = machine()
    coded = symbols(points, firsts)
    return start[coded, states_before(to[coded])]


class Merger:
    """Token ids of pre-tokens by merging adjacent parts, lowest rank first and leftmost of equals."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        #: All tokens' bytes end to end, and where each begins.
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.held = _Ragged(), 0

    def merge(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        # Parts are a linked list over the piece's bytes; an entry of the heap counts if its parts still stand.
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[piece[k : k + 2]], k, k + 1, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if ends[a] != b or b >= n or ends[b] != end:
                continue
            ends[a], ends[b], after[a] = end, -1, after[b]
            if after[a] < n:
                before[after[a]] = a
                if (rank := ranks.get(piece[a : ends[after[a]]])) is not None:
                    heapq.heappush(heap, (rank, a, end, ends[after[a]]))
            if before[a] >= 0 and (rank := ranks.get(piece[before[a] : end])) is not None:
                heapq.heappush(heap, (rank, before[a], a, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : ends[at]]])
            at = after[at]
        return out

    def of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one after the other, and the number of ids of each."""
        if len(self.known) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.clear()
        new = [p for p in pieces if p not in self.known]
        found = [self.merge(p) for p in new]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.held += sum(map(len, new))
        self.ids.extend(np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64))
        return self.ids.take(np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), one after the other, and the number of ids of each."""
        raw = [(t or "").encode() for t in texts.to_pylist()]
        joined, sizes = b"".join(raw), np.array([len(r) for r in raw], np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        # A code point begins at every byte that does not continue one.
        places = np.flatnonzero(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80)
        begin = np.cumsum(sizes) - sizes
        firsts = np.zeros(len(points), bool)
        firsts[np.searchsorted(places, begin[sizes > 0])] = True
        cuts = np.append(places[starts(points, firsts)], len(joined))
        del points, places, firsts
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(joined)]).dictionary_encode()
        ids, counts = self.of(pieces.dictionary.to_pylist())
        mine = _Ragged()
        mine.extend(ids, counts)
        ids, counts = mine.take(pieces.indices.to_numpy().astype(np.int64))
        # The pieces of a text are those that begin within it.
        edges = np.searchsorted(cuts[:-1], np.append(begin, len(joined)))
        return ids, _sums(counts, np.diff(edges))

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends among the decoded bytes of all ids."""
        return np.cumsum(self.starts[ids.astype(np.int64) + 1] - self.starts[ids])

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each token ends there."""
        ends = self.ends(ids)
        sizes = np.diff(ends, prepend=0)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes(), ends


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def _cut(flat: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Consecutive stretches of an array as little-endian bytes."""
    return pa.array([part.astype(kind).tobytes() for part in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else [], pa.binary())


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ends: bool = False) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_tokens and ids (little-endian 32 bit); on request also ends, the byte offset (64 bit) at which each token ends in the UTF-8 text.

    Null and empty texts have no tokens. Special tokens are ordinary text. Repeated rows and null ids stay as they are, other columns are
    ignored, an empty table gives no rows. A text of any length is read whole.
    """

    def run(batches):
        merger = _merger(ranks_path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                ids, counts = merger.encode(batch.column(1))
                out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids": _cut(ids, counts, "<u4")}
                if with_ends:
                    ends = merger.ends(ids)
                    before = np.insert(ends, 0, 0)
                    out["ends"] = _cut(ends - np.repeat(before[np.cumsum(counts) - counts], counts), counts, "<i8")
                yield pa.RecordBatch.from_pydict(out)

    given = pick(docs, doc_id=id_col, text=text_col)
    return given.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", ends binary" * with_ends)


def decode(tokens: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns of each row and ``bytes``, the decoded bytes of its ids (null: none); unknown ids are an error."""

    def run(batches):
        merger = _merger(ranks_path)
        for whole in batches:
            for batch in slices(whole, batch_ids, SLICE_BYTES):
                packed = [x or b"" for x in batch.column(batch_ids).to_pylist()]
                counts = np.array([len(x) // 4 for x in packed], np.int64)
                text, ends = merger.decode(np.frombuffer(b"".join(packed), "<u4"))
                edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
                parts = pa.array([text[a:b] for a, b in zip(edges, edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch_ids)), parts], names=[*keep, "bytes"])

    batch_ids = len(keep)
    given = tokens.select(*keep, ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: its text encoded, and the ids decoded again."""
    tokens = encode(docs, ranks_path, id_col, text_col).select("doc_id", "n_tokens", _digest(F.col("ids")).alias("ids_sha256"), "ids")
    back = decode(tokens, ranks_path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", _digest(F.col("bytes")).alias("decoded_sha256"))


def _digest(column: Column) -> Column:
    return F.sha2(column, 256)
