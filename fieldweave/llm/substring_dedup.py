"""Fuzzy repeated passages by seeding, collinear chaining and alignment.

Every document yields seeds: the minimisers of its ``K``-word windows, so that any run of
``K + WINDOW - 1`` shared words shares a seed. Seeds go once, packed, to the task of their part of the hash range, and those
that only one document holds end there. Longer seeds, with heads of their own, are drawn beside them, so that
earlier uses of single phrases cannot take a passage away. Each seed is joined to the first document that
holds it (its head), which keeps the join linear however often a passage occurs. For each
pair of document and head, matches on one diagonal become segments, and segments are chained in order
of both texts with a cost for gaps: a Fenwick tree over the positions in the head holds the best
score of a chain that ends before any place. Chains are aligned word by word, extended at both ends,
and kept where at least ``identity`` of the words agree; a chain that falls short is cut at its costliest
gap, and each side is judged on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldweave.llm.decontaminate import split_words
from fieldweave.llm.packing import slices
from fieldweave.llm.storage import stage

#: Words of a seed.
K = 5
#: Consecutive seeds of which the least is kept.
WINDOW = 2
#: The same of the longer seeds.
LONG_K, LONG_WINDOW = 12, 8
#: Bits of a seed's hash, and how many leading ones of them name at least and at most the range it is dealt to.
HASH_BITS, RANGE_BITS = 52, (12, 30)
#: Words of the corpus for each range (about as many seeds), beyond the least number of ranges.
WORDS_A_RANGE = 1 << 20
#: Seeds of a range that are unpacked at once.
SEEDS_AT_ONCE = 1 << 19
#: Cost of a word of gap, in either text, against the gain of a covered word.
GAP_COST = 0.2
#: Longest gap, in words, within one diagonal segment.
NEAR = 48
#: Ends are extended by at most so many words, until the score has dropped by DROP. What agrees beyond has seeds, and so chains, of its own.
STRETCH, DROP = 256, 8
#: Words that the matches of a chain must span for it to be aligned.
LEAST_SPAN = 8
#: Words of a stretch that is reported.
LEAST_CHAIN = 15


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and the number of words of each."""
    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64), counts


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` (a power of two) consecutive values."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _minimisers(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of a text's minimisers among its ``k``-word windows, at every place where they stand."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    if n <= window:
        chosen = h == h.min()
    else:
        least = _slide(h, window, np.minimum)
        # A value is a minimiser if some window it lies in has no lesser one.
        padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
        chosen = _slide(padded, window, np.maximum) == h
    at = np.flatnonzero(chosen)
    return h[at], at


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of a text's seeds; the last of the hash's bits is set for a long one."""
    (short, at), (long, long_at) = _minimisers(words, K, WINDOW), _minimisers(words, LONG_K, LONG_WINDOW)
    h = np.concatenate([short, long]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - HASH_BITS) << np.uint64(1)
    h[len(short) :] |= np.uint64(1)
    return h, np.concatenate([at, long_at])


def range_bits(words: int) -> int:
    """Leading bits of a seed's hash that name its range, so that ranges hold about as much whatever the size of the corpus."""
    least, most = RANGE_BITS
    return min(most, max(least, (words // WORDS_A_RANGE).bit_length()))


def _seed_rows(batches, bits: int):
    """The seeds of some documents (doc_id, codes), packed by range: the hash's low 32 bits and the next 8, document (as differences) and place."""
    for whole in batches:
        for batch in slices(whole, 1, 4 << 20):
            found = [seeds_of(np.frombuffer(c.as_buffer(), "<u4").astype(np.uint64)) for c in batch.column(1)]
            h = np.concatenate([f[0] for f in found])
            doc, pos = np.repeat(batch.column(0).to_numpy(), [len(f[0]) for f in found]), np.concatenate([f[1] for f in found]).astype("<i4")
            part = (h >> np.uint64(HASH_BITS - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, h, doc, pos = part[order], h[order], doc[order].astype("<i8"), pos[order]
            low, high = h.astype("<u4"), (h >> np.uint64(32)).astype(np.uint8)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            rows = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            packed = [low[a:b].tobytes() + high[a:b].tobytes() + _squeeze.compress(np.diff(doc[a:b], prepend=0).astype("<i8").tobytes() + pos[a:b].tobytes(), asbytes=True) for a, b in rows]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in rows], pa.int32()), pa.array([b - a for a, b in rows], pa.int32()), pa.array(packed, pa.binary())], names=["range", "n", "packed"])


_squeeze = pa.Codec("zstd", compression_level=1)


def _heads(h, doc, pos, last):
    """For each hash its first (document, place) and its last document."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos, last = h[order], doc[order], pos[order], last[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
    return h[first], doc[first], pos[first], np.maximum.reduceat(last, first)


def _match_rows(batches):
    """(doc_id, rep, match): every place of a seed against the first that holds it, if that is in an earlier document; a match is the place, the head's place and one bit for a long seed, in one number. Packed rows come sorted by range; a range is held packed and unpacked a part at a time."""
    now, held = None, []

    def parts():
        some, size = [], 0
        for k, (n, p) in enumerate(held):
            rest = _squeeze.decompress(p[5 * n :], decompressed_size=12 * n, asbytes=True)
            h = np.frombuffer(p, "<u4", n).astype(np.int64) | np.frombuffer(p, np.uint8, n, 4 * n).astype(np.int64) << 32
            some.append((h, np.frombuffer(rest, "<i8", n).cumsum(), np.frombuffer(rest, "<i4", n, 8 * n)))
            size += n
            if size >= SEEDS_AT_ONCE or k == len(held) - 1:
                yield [np.concatenate(c) for c in zip(*some)]
                some, size = [], 0

    def work():
        heads = None
        for h, doc, pos in parts():
            own = _heads(h, doc, pos, doc)
            heads = own if heads is None else _heads(*[np.concatenate(c) for c in zip(heads, own)])
        shared = heads[1] < heads[3]
        heads = [c[shared] for c in heads]
        for h, doc, pos in parts() if len(heads[0]) else ():
            at = np.minimum(np.searchsorted(heads[0], h), len(heads[0]) - 1)
            own = (heads[0][at] == h) & (doc > heads[1][at])
            at = at[own]
            match = pos[own].astype(np.int64) << 32 | heads[2][at].astype(np.int64) << 1 | h[own] & 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(heads[1][at]), pa.array(match)], names=["doc_id", "rep", "match"])

    for batch in batches:
        for r, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and r != now:
                yield from work()
                held.clear()
            now = r
            held.append((n, packed))
    if held:
        yield from work()


def _code_rows(batches):
    """The words of each document as 32-bit hashes, and their number."""
    for whole in batches:
        for batch in slices(whole, 1, 4 << 20):
            hashes, counts = word_hashes(batch.column(1).to_pylist())
            codes, ends = hashes.astype("<u4"), np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codes[e - n : e].tobytes() for e, n in zip(ends, counts)], pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "codes", "n_words"])


def _stretch(codes: str, low: str, high: str):
    """Of a text's codes those from word ``low`` up to ``high``."""
    return F.expr(f"substring({codes}, 4 * {low} + 1, 4 * ({high} - {low}))")


class Fenwick:
    """Greatest (score, index) over a prefix of places."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, place: int, score: float, index: int) -> None:
        place += 1
        while place < len(self.best):
            if self.best[place][0] < score:
                self.best[place] = (score, index)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        """The greatest over places 0 to ``place``."""
        place, found = place + 1, (-1e18, -1)
        while place:
            if self.best[place][0] > found[0]:
                found = self.best[place]
            place &= place - 1
        return found


def segments(x: np.ndarray, y: np.ndarray, width: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches of ``width`` words joined along diagonals: (x from, x to, y from, y to)."""
    order = np.lexsort((x, y - x))
    x, y, ends = x[order], y[order], (x + width)[order]
    cut = np.flatnonzero((np.diff(y - x) != 0) | (np.diff(x) > NEAR)) + 1
    first = np.concatenate([[0], cut])
    ends = np.maximum.reduceat(ends, first)
    return sorted(zip(x[first].tolist(), ends.tolist(), y[first].tolist(), (ends + y[first] - x[first]).tolist()))


def chains(parts: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Collinear chains of segments, best first, each segment in one chain at most."""
    if len(parts) == 1:
        return [parts]
    places = {v: i for i, v in enumerate(sorted({p[2] for p in parts} | {p[3] for p in parts}))}
    tree = Fenwick(len(places))
    score, before = [0.0] * len(parts), [-1] * len(parts)
    events = sorted([(p[0], 1, i) for i, p in enumerate(parts)] + [(p[1], 0, i) for i, p in enumerate(parts)])
    # At one place, segments that end come before those that begin.
    for _, begins, i in events:
        x0, x1, y0, y1 = parts[i]
        if not begins:
            tree.put(places[y1], score[i] + GAP_COST * (x1 + y1), i)
            continue
        score[i] = float(x1 - x0)
        best, j = tree.upto(places[y0])
        gain = best - GAP_COST * (x0 + y0)
        if j >= 0 and gain > 0:
            score[i], before[i] = score[i] + gain, j
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(parts[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _chain_rows(batches):
    """The chains of each pair of document and head, best first, with the words of both that they and their extensions can reach, of matches that come sorted by both."""
    held = None

    def work(doc, rep, match):
        x, y, width = match >> 32, match >> 1 & 0x7FFFFFFF, np.where(match & 1, LONG_K, K)
        out = []
        cut = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(rep) != 0)) + 1, [len(doc)]])
        if len(doc):
            span = np.maximum.reduceat(x + width, cut[:-1]) - np.minimum.reduceat(x, cut[:-1])
            for g in np.flatnonzero(span >= LEAST_SPAN):
                a, b = cut[g], cut[g + 1]
                found = [[v for part in chain for v in part] for chain in chains(segments(x[a:b], y[a:b], width[a:b])) if chain[-1][1] - chain[0][0] >= LEAST_SPAN]
                if found:
                    reach = [v for k in (0, 2) for v in (max(0, min(c[k] for c in found) - STRETCH), max(c[k - 3] for c in found) + STRETCH)]
                    out.append((int(doc[a]), int(rep[a]), found, *reach))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), *[pa.int32()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=["doc_id", "rep", "chains", "start", "stop", "rep_start", "rep_stop"])

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now)]
        if not len(now[0]):
            continue
        # The last pair may go on in the next batch.
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        end = int(last[-1]) + 1 if len(last) else 0
        if end:
            yield work(*[a[:end] for a in now])
        held = [a[end:] for a in now]
    if held is not None:
        yield work(*held)


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """Words by which two texts go on alike, before the score drops."""
    n = min(len(a), len(b), STRETCH)
    if not n:
        return 0
    s = np.where(a[:n] == b[:n], 1, -2).cumsum()
    stop = np.flatnonzero(s < np.maximum(np.maximum.accumulate(s), 0) - DROP)
    s = s[: stop[0]] if len(stop) else s
    return int(s.argmax()) + 1 if len(s) and s.max() > 0 else 0


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, in order: the longest common subsequence, a row of its table at a time as the bits of a number."""
    if not len(a) or not len(b):
        return 0
    at: dict[int, int] = {}
    for k, word in enumerate(b.tolist()):
        at[word] = at.get(word, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for word in a.tolist():
        both = row & at.get(word, 0)
        row = (row + both | row - both) & full
    return len(b) - row.bit_count()


def _measure(a: np.ndarray, b: np.ndarray, quads: list, known: dict) -> tuple[tuple[int, int, int, int, int], list[int]]:
    """A chain's span in both texts after extension with the words that agree, and the words that do not in each gap."""
    x0, y0, x1, y1 = quads[0][0], quads[0][2], quads[-1][1], quads[-1][3]
    matched, px, py, lost = 0, x0, y0, []
    for xa, xb, ya, yb in quads:
        if (px, xa, py, ya) not in known:
            known[px, xa, py, ya] = _agree(a[px:xa], b[py:ya])
        inner = known[px, xa, py, ya]
        lost.append(max(xa - px, ya - py) - inner)
        matched += inner + int((a[xa:xb] == b[ya:yb]).sum())
        px, py = xb, yb
    left = _extend(a[:x0][::-1], b[:y0][::-1])
    right = _extend(a[x1:], b[y1:])
    matched += int((a[x0 - left : x0] == b[y0 - left : y0]).sum()) + int((a[x1 : x1 + right] == b[y1 : y1 + right]).sum())
    return (x0 - left, x1 + right, y0 - left, y1 + right, matched), lost[1:]


def _halves(a: np.ndarray, b: np.ndarray, quad) -> list[list]:
    """A segment cut at its longest run of words that differ; nothing if it has none."""
    xa, xb, ya, yb = quad
    same = np.flatnonzero(a[xa:xb] == b[ya:yb])
    if len(same) < 2 or (wide := np.diff(same)).max() == 1:
        return []
    k = int(wide.argmax())
    return [[(xa + u, xa + v + 1, ya + u, ya + v + 1)] for u, v in ((int(same[0]), int(same[k])), (int(same[k + 1]), int(same[-1]))) if v + 1 - u >= K]


def align(a: np.ndarray, b: np.ndarray, parts: list[int], identity: float) -> list[tuple[int, int, int, int, int]]:
    """The stretches of a chain that agree well enough: (span in a, span in b, words that agree). A chain that fails is cut at its costliest gap, a segment at its longest difference, and each side is judged on its own."""
    known, open_, out = {}, [[tuple(parts[i : i + 4]) for i in range(0, len(parts), 4)]], []
    while open_:
        quads = open_.pop()
        span, lost = _measure(a, b, quads, known)
        if span[4] >= identity * max(span[1] - span[0], span[3] - span[2]):
            out.append(span)
        elif lost:
            k = max(range(len(lost)), key=lost.__getitem__) + 1
            open_ += [quads[:k], quads[k:]]
        else:
            open_ += _halves(a, b, quads[0])
    return out


def _align_rows(identity: float):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, 6, 8 << 20):
                out = []
                for row in batch.to_pylist():
                    a, b, start, other = np.frombuffer(row["codes"], "<u4"), np.frombuffer(row["rep_codes"], "<u4"), row["start"], row["rep_start"]
                    covered = np.zeros(len(a), bool)
                    for parts in row["chains"]:
                        parts = [v - (start if k % 4 < 2 else other) for k, v in enumerate(parts)]
                        # What a better chain of the pair has reported needs no second row: in repetitive texts nearly every place fits every other.
                        if covered[parts[0] : parts[-3]].all():
                            continue
                        for x0, x1, y0, y1, matched in align(a, b, parts, identity):
                            if x1 - x0 >= LEAST_CHAIN:
                                covered[x0:x1] = True
                                out.append((row["doc_id"], start + x0, start + x1, row["rep"], other + y0, other + y1, matched, matched / max(x1 - x0, y1 - y0)))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)], names=["doc_id", "start_word", "end_word", "other_doc_id", "other_start", "other_end", "matched_words", "identity"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = 40, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each passage of a document that an earlier document holds (exactly or nearly).

    doc_id, start_word, end_word and other_doc_id, other_start, other_end give the passage's words in both
    documents (A-Z in lower case, letters and digits; ends exclusive), matched_words and identity how
    far they agree. Stretches of a document that touch or overlap count together towards ``min_words``. A
    passage with evenly drawn substitutions is found with a chance of 0.9 or more from 50 words on at 0.85 of its words in
    common, and from 60 words on at 0.8; one of barely ``min_words`` may measure as shorter, as its ends are trimmed to words
    that agree. A passage in many documents gives one row for each but the first that holds it; copies of whole documents
    are passages like any other. ``min_words`` and ``identity`` are what a reported passage has at least. Null and empty texts hold none, rows with a null id are left out, rows
    that repeat an id count once, other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    codes = stage(source.mapInArrow(_code_rows, "doc_id long, codes binary, n_words long"), "codes")
    bits = range_bits(codes.agg(F.sum("n_words")).first()[0] or 0)
    codes = codes.select("doc_id", "codes")
    packed = codes.mapInArrow(lambda batches: _seed_rows(batches, bits), "range int, n int, packed binary")
    matches = packed.repartition("range").sortWithinPartitions("range").mapInArrow(_match_rows, "doc_id long, rep long, match long")
    chained = matches.repartition("doc_id", "rep").sortWithinPartitions("doc_id", "rep", "match")
    found = stage(chained.mapInArrow(_chain_rows, "doc_id long, rep long, chains array<array<int>>, start int, stop int, rep_start int, rep_stop int"), "chains")
    # Of both texts only what the chains can reach goes on.
    cut = found.join(codes, "doc_id").withColumn("codes", _stretch("codes", "start", "stop"))
    # A document that many others repeat is one row here, so its join may be split among tasks.
    theirs = codes.select(F.col("doc_id").alias("rep"), F.col("codes").alias("rep_codes"))
    paired = cut.join(theirs, "rep").select("doc_id", "rep", "chains", "start", "rep_start", "codes", _stretch("rep_codes", "rep_start", "rep_stop").alias("rep_codes"))
    aligned = paired.mapInArrow(_align_rows(identity), "doc_id long, start_word int, end_word int, other_doc_id long, other_start int, other_end int, matched_words int, identity double").distinct()
    # Touching stretches of a document are one passage for the length it must have.
    order = W.partitionBy("doc_id").orderBy("start_word", "end_word", "other_doc_id", "other_start")
    reach = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = aligned.withColumn("new", F.when(F.col("start_word") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    island = W.partitionBy("doc_id", "island")
    return marked.withColumn("words", F.max("end_word").over(island) - F.min("start_word").over(island)).where(F.col("words") >= min_words).drop("new", "island", "words")
