"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes and letter n-grams (with word borders) and the word itself
as a lexicon entry, hashed into one table of weights a label. Learned transition weights
join the labels of neighbouring words, so a code-switched text is labelled word by word
by forward-backward over the whole text; its language is the one with the largest share of the
words' marginal probabilities. Weights are fitted by gradient ascent on the conditional
log-likelihood of a bounded sample of labelled documents, some spliced from two languages.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.packing import slices

#: Size of the hashed weight table.
TABLE_BITS = 18
#: Letters of a word; a longer run of letters is several words.
LETTERS = 24
#: Words that inference steps over at once; what a block of words hands on to the next is exact.
CHAIN = 64
#: Blocks, and characters of a text, that are worked on at once, which bounds a worker's memory.
BLOCKS_AT_ONCE, TEXT_AT_ONCE = 4096, 1 << 22
#: Words whose emissions a worker remembers before it starts afresh, fewer if they have more than CACHE_VALUES values.
CACHE_WORDS, CACHE_VALUES = 250_000, 4_000_000
#: Labels between which moves are weighed within a text: those that its words speak for most, of all labels.
BEAM = 64
#: Ranges of scripts written without spaces (Thai and Lao, Burmese, Khmer, kana, ideographs), of which two letters make a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Blocks of signs, digits and spaces, which part words. Letters within them do not.
_SIGNS = (
    (0x00, 0x40), (0x5B, 0x60), (0x7B, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x303F), (0xFE30, 0xFE4F), (0xFF00, 0xFF65), (0x1F000, 0x1FAFF),
)


def _spans(points) -> str:
    """Rising code points as ranges of a character class."""
    out = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_PARTING = _spans(c for a, b in _SIGNS for c in range(a, b + 1) if not chr(c).isalpha())
_WORD = re.compile(f"[{_UNSPACED}]{{1,2}}|[^{_PARTING}{_UNSPACED}]{{1,{LETTERS}}}")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def has_letter(text: str | None) -> bool:
    return text is not None and (any(c.isascii() and c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text))


def features_of(words: list[str]) -> np.ndarray:
    """Table rows of each word's features; the last table row stands for no feature."""
    letters = np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    n = (letters > 0).sum(1)
    rows = np.arange(len(words))
    x = np.zeros((len(words), LETTERS + 2), np.uint64)
    x[:, 0] = 1
    x[:, 1:-1] = letters
    x[rows, n + 1] = 2
    none = np.int64((1 << TABLE_BITS) - 1)
    out = []

    def add(hashes, valid):
        h = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
        out.append(np.where(valid, np.minimum(h.astype(np.int64), none - 1), none))

    end = (n + 2)[:, None]
    for size in (2, 3, 4):
        width = LETTERS + 3 - size
        h = reduce(lambda a, k: a * np.uint64(1_000_003) + x[:, k : k + width], range(size), np.uint64(size) * np.ones((len(words), width), np.uint64))
        valid = np.arange(width)[None, :] + size <= end
        # Pairs and triples at every place; of the longer ones only those at the borders, as affixes.
        if size < 4:
            add(h, valid)
        else:
            add(h[:, :1], valid[:, :1])
            last = np.maximum(n - 2, 0)
            add(h[rows, last][:, None], (n >= 2)[:, None])
    add(reduce(lambda a, k: a * np.uint64(1_000_003) + x[:, k], range(LETTERS + 2), np.full(len(words), 7, np.uint64))[:, None], np.ones((len(words), 1), bool))
    return np.concatenate(out, 1)


class ChainModel:
    """Weights and inference of the random field. The table of weights gets fewer rows where there are many labels, so its size is bounded."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.bits = min(TABLE_BITS, max(8, TABLE_BITS + 5 - max(len(labels) - 1, 1).bit_length()))
        self.weights = np.zeros((1 << self.bits, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)), np.float32)

    def folded(self, features: np.ndarray) -> np.ndarray:
        """Table rows of features in this model's table."""
        if self.bits == TABLE_BITS:
            return features
        none = (1 << self.bits) - 1
        return np.where(features == (1 << TABLE_BITS) - 1, none, features % none)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        features = self.folded(features)
        out = np.zeros((len(features), len(self.labels)), np.float32)
        for f in range(features.shape[1]):
            out += self.weights[features[:, f]]
        return out

    def marginals(self, emissions: np.ndarray, real: np.ndarray, enter=None, leave=None) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains (rows) at once: each word's label probabilities, and the expected moves between labels.

        ``real`` tells words from padding, which comes last. ``enter`` and ``leave`` are what the words before and after a
        chain say of its first and last label; nothing if absent.
        """
        chains, length, k = emissions.shape
        local = np.exp(emissions - emissions.max(2, keepdims=True))
        moves = np.exp(self.moves)
        forward, backward = np.empty_like(local), np.ones_like(local)
        after = np.float32(1.0) if leave is None else leave
        a = local[:, 0] if enter is None else local[:, 0] * enter
        forward[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, length):
            a = (forward[:, t - 1] @ moves) * local[:, t]
            forward[:, t] = a / a.sum(1, keepdims=True)
        backward[:, -1] = after
        for t in range(length - 2, -1, -1):
            b = (local[:, t + 1] * backward[:, t + 1]) @ moves.T
            backward[:, t] = np.where(real[:, t + 1, None], b / b.sum(1, keepdims=True), after)
        p = forward * backward
        p /= p.sum(2, keepdims=True)
        return p, (forward, backward, local, moves)

    def transfer(self, emissions: np.ndarray, real: np.ndarray) -> np.ndarray:
        """For each chain, up to a factor, the weight of all its labellings from a first label (its own emission included) to a last one."""
        local = np.exp(emissions - emissions.max(2, keepdims=True))
        moves = np.exp(self.moves)
        out = local[:, 0, :, None] * np.eye(local.shape[2], dtype=np.float32)
        for t in range(1, local.shape[1]):
            new = (out @ moves) * local[:, t, None, :]
            out = np.where(real[:, t, None, None], new / new.max((1, 2), keepdims=True), out)
        return out

    def expected_moves(self, parts, real: np.ndarray) -> np.ndarray:
        forward, backward, local, moves = parts
        after = (local * backward)[:, 1:]
        joint = np.einsum("cti,ij,ctj->ctij", forward[:, :-1], moves, after)
        joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-30)
        return (joint * real[:, 1:, None, None]).sum((0, 1))

    def fit(self, chains: list[tuple[list[str], list[int]]], steps: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> ChainModel:
        """Adaptive gradient ascent on the conditional log-likelihood of labelled chains."""
        length = max(len(w) for w, _ in chains)
        vocabulary: dict[str, int] = {}
        index = np.zeros((len(chains), length), np.int64)
        truth = np.zeros((len(chains), length), np.int64)
        real = np.zeros((len(chains), length), bool)
        for i, (words, labels) in enumerate(chains):
            index[i, : len(words)] = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            truth[i, : len(words)], real[i, : len(words)] = labels, True
        features = features_of(list(vocabulary))
        k = len(self.labels)
        wanted = np.eye(k, dtype=np.float32)[truth] * real[:, :, None]
        seen_moves = np.zeros((k, k))
        np.add.at(seen_moves, (truth[:, :-1][real[:, 1:]], truth[:, 1:][real[:, 1:]]), 1)
        seen_w, seen_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        total = real.sum()
        flat = self.folded(features).ravel()
        for _ in range(steps):
            p, parts = self.marginals(self.emissions(features)[index], real)
            gap = (wanted - p * real[:, :, None]).reshape(-1, k) / total
            by_word = np.stack([np.bincount(index.ravel(), gap[:, j], len(vocabulary)) for j in range(k)], 1)
            slope = np.stack([np.bincount(flat, np.repeat(by_word[:, j], features.shape[1]), 1 << self.bits) for j in range(k)], 1) - ridge * self.weights / total
            slope[-1] = 0
            slope_m = (seen_moves - self.expected_moves(parts, real)) / total
            seen_w += slope**2
            seen_m += slope_m**2
            self.weights += (rate * slope / np.sqrt(seen_w) * (slope != 0)).astype(np.float32)
            self.moves += (rate * slope_m / np.sqrt(seen_m)).astype(np.float32)
        return self


class Labeller:
    """Texts' languages under a model, remembering words' emissions."""

    def __init__(self, model: ChainModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.labels)), np.float32)

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the texts, one after the other, and the number of words of each."""
        if len(self.index) > min(CACHE_WORDS, CACHE_VALUES // len(self.model.labels)):
            self.clear()
        index, known, parts, counts = self.index, len(self.index), [], []
        for text in texts:
            at, n, text = 0, 0, text or ""
            while at < len(text):
                # A very long text is read a part at a time, from one space to another where there is one.
                end = text.find(" ", at + TEXT_AT_ONCE, at + 2 * TEXT_AT_ONCE) if len(text) - at > TEXT_AT_ONCE else len(text)
                end = end if end > 0 else at + TEXT_AT_ONCE
                words = words_of(text[at:end])
                parts.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
                at, n = end, n + len(words)
            counts.append(n)
        if len(index) > known:
            fresh = list(islice(index, known, None))
            new = [self.model.emissions(features_of(fresh[i : i + 20_000])) for i in range(0, len(fresh), 20_000)]
            self.rows = np.concatenate([self.rows, *new])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64)

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the label probabilities of each text's words, and the number of its words.

        Texts are cut into blocks of CHAIN words. The transfers of the blocks, multiplied from either end, give what the words
        before and after say of a block, so its marginals are those of forward-backward over the whole text. Beyond BEAM labels each text weighs its own.
        """
        codes, counts = self._codes(texts)
        k = len(self.model.labels)
        if k <= BEAM:
            return self._shares(codes, counts, self.rows, self.model), counts
        sums, ends = np.zeros((len(texts), k)), np.cumsum(counts)
        for i in np.flatnonzero(counts).tolist():
            own = codes[ends[i] - counts[i] : ends[i]]
            spoken = sum((self.rows[own[at : at + CACHE_WORDS]].sum(0, dtype=float) for at in range(0, len(own), CACHE_WORDS)), np.zeros(k))
            beam = np.sort(np.argsort(-spoken, kind="stable")[:BEAM])
            words, rows = np.unique(own, return_inverse=True)
            part = ChainModel([self.model.labels[b] for b in beam])
            part.moves = self.model.moves[np.ix_(beam, beam)]
            sums[i, beam] = self._shares(rows.ravel(), counts[i : i + 1], self.rows[np.ix_(words, beam)], part)[0]
        return sums, counts

    @staticmethod
    def _shares(codes: np.ndarray, counts: np.ndarray, known: np.ndarray, model: ChainModel) -> np.ndarray:
        """Sums of label probabilities of texts' words (rows of ``known``)."""
        k, blocks = len(model.labels), -(-counts // CHAIN)
        first, total = np.cumsum(blocks) - blocks, int(blocks.sum())
        sums = np.zeros((len(counts), k))
        if not total:
            return sums
        of_text = np.repeat(np.arange(len(counts)), blocks)
        start = np.repeat(np.cumsum(counts) - counts, blocks) + (np.arange(total) - first[of_text]) * CHAIN
        size = np.minimum(CHAIN, np.cumsum(counts)[of_text] - start)
        enter, leave = np.ones((total, k), np.float32), np.ones((total, k), np.float32)

        def words(rows):
            real = np.arange(CHAIN) < size[rows][:, None]
            return known[codes[np.minimum(start[rows][:, None] + np.arange(CHAIN), len(codes) - 1)]] * real[:, :, None], real

        many = np.flatnonzero(blocks[of_text] > 1)
        if len(many):
            whole = np.empty((total, k, k), np.float32)
            for at in range(0, len(many), BLOCKS_AT_ONCE):
                rows = many[at : at + BLOCKS_AT_ONCE]
                whole[rows] = model.transfer(*words(rows))
            moves, long = np.exp(model.moves), np.argsort(-blocks, kind="stable")
            most = blocks[long]
            for j in range(1, int(most[0])):
                now = long[: np.searchsorted(-most, -j)]
                rows = first[now] + j
                a = np.einsum("ni,nij->nj", enter[rows - 1], whole[rows - 1]) @ moves
                enter[rows] = a / a.sum(1, keepdims=True)
                rows = first[now] + blocks[now] - 1 - j
                b = np.einsum("nij,nj->ni", whole[rows + 1], leave[rows + 1]) @ moves.T
                leave[rows] = b / b.sum(1, keepdims=True)
        for at in range(0, total, BLOCKS_AT_ONCE):
            rows = np.arange(at, min(total, at + BLOCKS_AT_ONCE))
            emissions, real = words(rows)
            p = model.marginals(emissions, real, enter[rows], leave[rows])[0]
            np.add.at(sums, of_text[rows], (p * real[:, :, None]).sum(1))
        return sums

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums, counts = self.shares(texts)
        share = sums / np.maximum(counts, 1)[:, None]
        best, score = share.argmax(1), np.clip(share.max(1), 0.0, 1.0)
        return [(self.model.labels[b], float(p)) if n and has_letter(text) else (UNDETERMINED, 0.0) for text, n, b, p in zip(texts, counts, best, score)]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row's id, as text, falls in the part kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def pieces_of(text: str | None, per_document: int = 6, length: int = 32) -> list[list[str]]:
    """Stretches of a text, evenly spread over it."""
    words = words_of(text)
    starts = range(0, len(words), length)
    return [words[s : s + length] for s in list(starts)[:: max(1, len(starts) // per_document)][:per_document]]


def training_chains(pieces: list[tuple[list[str], str]], labels: list[str], length: int = 32) -> list[tuple[list[str], list[int]]]:
    """Chains of words with their labels from stretches of labelled texts; every third is spliced from two."""
    number = {label: i for i, label in enumerate(labels)}
    pure = sorted(((zlib.crc32(" ".join(words).encode("utf-8", "replace")), words, number[lang]) for words, lang in pieces), key=lambda x: x[0])
    out = []
    for j, (_, words, label) in enumerate(pure):
        if j % 3 == 0:
            _, other, second = pure[(j * 7 + 1) % len(pure)]
            cut = len(words) // 2
            out.append((words[:cut] + other[: length - cut], [label] * cut + [second] * len(other[: length - cut])))
        else:
            out.append((words, [label] * len(words)))
    return [c for c in out if c[0]]


def train_language_model(docs: DataFrame, sample_per_label: int = 500, sample_values: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ChainModel | None:
    """Fit on about ``sample_per_label`` labelled documents of each language (documented bounds; chosen by a hash of the id).

    All labels are learned. Where there are many, each has fewer documents, so that documents times labels times labels come to about ``sample_values`` (6 documents a label at
    least). Only some stretches of words of those documents come to the driver, so their bytes are bounded too.
    """
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sample_per_label = max(6, min(sample_per_label, sample_values // max(1, len(counts)) ** 2))
    if not counts:
        return None
    labels = sorted(counts)
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.create_map(*chain.from_iterable((F.lit(k), F.lit(sample_per_label / n)) for k, n in counts.items()))
    chosen = labelled.where(unit < chance[F.col(label_col)]).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))

    def run(batches):
        for batch in batches:
            found = [(i, " ".join(p), lang) for i, text, lang in zip(*(batch.column(c).to_pylist() for c in range(3))) for p in pieces_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*found)) or [()] * 3], names=["id", "piece", "label"])

    rows = chosen.limit(4 * sample_per_label * len(labels)).mapInArrow(run, "id string, piece string, label string").collect()
    chains = training_chains([(r.piece.split(" "), r.label) for r in sorted(rows, key=lambda r: (str(r.id), r.piece))], labels)
    return ChainModel(labels).fit(chains) if chains else None


def identify_languages(docs: DataFrame, model: ChainModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score.

    ``und`` and 0 where the text is null or has no letter, and everywhere without a model (no labelled
    rows). Repeated rows and null ids are kept as they come.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(held.value) if held.value is not None else None
        for whole in batches:
            for batch in slices(whole, text_at, TEXT_AT_ONCE):
                texts = batch.column(text_at).to_pylist()
                found = labeller.languages(texts) if labeller else [(UNDETERMINED, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "lang_score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")])
    names = kept.columns
    text_at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, fields + ", lang_pred string, lang_score double")
