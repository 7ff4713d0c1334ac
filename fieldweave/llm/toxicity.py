"""Toxicity by a weighted finite-state pattern grammar.

A word is read as the term of the lexicon it matches, as a target, negation or speech verb, or, by a machine of letters that reads stems and their
endings, as a form of a threatening verb.
Five small transducers with weights on their arcs read a clause: one turns terms into insults of the term's weight, one turns verbs
into threats, one marks both in the scope of a negation, one marks them in reported speech, one notes whether
somebody is addressed. They are composed into one machine, run over every clause that holds an insult or threat, and the weights
of the clauses' outputs make a text's score. The insult lexicon (words and stems) with its weights and the weights
of the outputs are learned from labelled texts; the rest of the grammar is stated below.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.packing import slices

# The grammar's closed word classes in English, German, French and Spanish.
NEGATION = "not no never isn't aren't don't nicht kein keine keinen nie niemals pas jamais aucun ni nunca jamás tampoco".split()
SPEECH = "said says say wrote writes called calls claimed claims quoted tweeted shouted sagte sagt schrieb nannte rief dit disait écrit appelé crié dijo dice escribió llamó gritó".split()
TARGET = "you your you're he she they them him her du dich dir ihr euch sie er tu toi te vous il elle ils usted ustedes tú ti vosotros él ella ellos".split()
# Stems of threatening verbs and the endings that inflect them, by language; irregular forms stand with the stems, to be read with no ending.
THREATS = {
    "kill murder destroy hurt shoot stab stabb hang burn": " s ed ing t",
    "shot hung": "",
    "töt zerstör erschieß umbring umzubring": "en e st est t et te ten test tet end",
    "erschoss erschossen umgebracht": "",
    "tu frapp brûl": "er e es ent ez ons erai eras era erons erez eront ai é ée és ant",
    "détrui": "re s t sent rai ras ra rons rez ront",
    "mat quem golpe": "ar o as a an amos aré arás ará arán aremos é ó aron ando ado",
    "destru": "ir yo yes ye yen iré irás irá irán í yó yeron yendo ido",
}
INSULT = "idiot moron stupid loser pathetic scum worthless trash disgusting clown dumb imbecile dummkopf trottel abschaum widerlich imbécile débile ordure minable estúpido imbécil basura inútil".split()
#: Words a negation reaches over.
SCOPE = 3
#: What a machine of letters reads after a word's last letter.
END = "end of word"
#: Prior weights of the features below, kept where the labels say nothing.
PRIOR = np.array([-4.0, 5.0, 0.5, 0.5, 1.0, 3.0, 0.5, 0.3])
#: Lengths of stems that are considered.
STEM_SIZES = (3, 4, 5, 6, 7, 8)
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """A deterministic weighted machine: ``arcs`` gives for (state, symbol) the next state, the symbol put out and the arc's weight; other symbols pass unchanged with weight 1."""

    def __init__(self, start, arcs: dict, default=None):
        self.start, self.arcs, self.default = start, arcs, default or {}

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol, 1.0)

    def run(self, symbols: list) -> tuple[list, list[float], object]:
        """The symbols put out, their weights, and the last state."""
        state, out, weights = self.start, [], []
        for symbol in symbols:
            state, said, weight = self.step(state, symbol)
            out.append(said)
            weights.append(weight)
        return out, weights, state

    def then(self, other: Transducer, symbols: list) -> Transducer:
        """The composition of this machine with one that reads its output; weights of arcs multiply."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            a, b = todo.pop()
            for symbol in symbols:
                a2, said, weight = self.step(a, symbol)
                b2, out, factor = other.step(b, said)
                arcs[(a, b), symbol] = ((a2, b2), out, weight * factor)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)


CLASSES = ["other", "verb", "target", "negation", "speech", "quote"]


def _insults(terms: dict[str, float]) -> Transducer:
    """A term of the lexicon is an insult of its weight."""
    return Transducer("any", {("any", ("term", t)): ("any", "insult", w) for t, w in terms.items()})


def _threats() -> Transducer:
    return Transducer("any", {("any", "verb"): ("any", "threat", 1.0)})


def _negation() -> Transducer:
    """A negation reaches over SCOPE words."""
    arcs = {}
    for left in range(SCOPE + 1):
        arcs[left, "negation"] = (SCOPE, "negation", 1.0)
        if left:
            arcs[left, "insult"] = (left - 1, "negated insult", 1.0)
            arcs[left, "threat"] = (left - 1, "negated threat", 1.0)
    return Transducer(0, arcs, {left: max(0, left - 1) for left in range(SCOPE + 1)})


def _reported() -> Transducer:
    """What follows a speech verb to the clause's end, and what stands in quotes, is reported; a closing quote ends it."""
    arcs = {(state, said): (state, f"reported {said}", 1.0) for state in ("told", "quoted") for said in ("insult", "threat", "negated insult", "negated threat")}
    arcs |= {("own", "speech"): ("told", "speech", 1.0), ("own", "quote"): ("quoted", "quote", 1.0), ("told", "quote"): ("quoted", "quote", 1.0), ("quoted", "quote"): ("own", "quote", 1.0)}
    return Transducer("own", arcs)


def _addressed() -> Transducer:
    return Transducer("no one", {("no one", "target"): ("someone", "target", 1.0)})


def machines(terms: dict[str, float]) -> tuple[list[Transducer], list]:
    """The grammar's transducers, in the order in which they read, and the symbols of the first."""
    return [_insults(terms), _threats(), _negation(), _reported(), _addressed()], [*CLASSES, *(("term", t) for t in terms)]


def grammar(terms: dict[str, float]) -> Transducer:
    parts, symbols = machines(terms)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.then(part, symbols)
    return whole


def inflections(groups: dict[str, str]) -> Transducer:
    """A machine of letters: reads a stem and one of its endings (a blank stands for none), letter by letter, and is then in the state ``True``.

    States are what has been read; from a stem an arc leads on by the letters of each ending.
    """
    arcs: dict = {}

    def lay(word: str) -> None:
        state = ""
        for letter in word:
            arcs[state, letter] = (state + letter, letter, 1.0)
            state += letter
        arcs[state, END] = (True, END, 1.0)

    for stems, endings in groups.items():
        for stem in stems.split():
            for ending in {*endings.split(), *([""] if not endings or endings.startswith(" ") else [])}:
                lay(stem + ending)
    lost = {state: None for state, _ in arcs}
    return Transducer("", arcs, lost | {None: None, True: None})


class Lexicon:
    """Weighted insults: whole words, and stems that any ending may follow."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.classes = {w: t for t, ws in (("target", TARGET), ("negation", NEGATION), ("speech", SPEECH)) for w in ws}
        self.verbs = inflections(THREATS)
        self.stem_sizes = sorted({len(s) for s in stems}, reverse=True)
        # Words by themselves, stems marked by a hyphen.
        self.grammar = grammar({w: x for w, x in words.items() if x > 0} | {f"{s}-": x for s, x in stems.items() if x > 0})

    def symbol(self, word: str):
        """What the grammar reads a word as: a term with a weight (the word itself before a stem), else its class."""
        weight = self.words.get(word)
        if weight is None:
            stem = next((word[:n] for n in self.stem_sizes if word[:n] in self.stems), None)
            if stem is not None and self.stems[stem] > 0:
                return "term", f"{stem}-"
        elif weight > 0:
            return "term", word
        if not word[0].isalpha():
            return "quote"
        own = self.classes.get(word)
        return own or ("verb" if self.verbs.run([*word, END])[2] is True else "other")

    def __reduce__(self):
        # The machine is composed anew from the lexicon.
        return Lexicon, (self.words, self.stems)

    def finder(self):
        """Finds where a lower-cased text may hold an insult or threat."""
        machine = ahocorasick.Automaton()
        words = {w for w, weight in self.words.items() if weight > 0 and not any(w.startswith(s) for s in self.stems)}
        for term in {*words, *self.stems, *(stem for stems in THREATS for stem in stems.split())}:
            machine.add_word(term, len(term))
        machine.make_automaton()
        return machine


def clause_outputs(words: list[str], lexicon: Lexicon) -> tuple[dict[str, float], bool]:
    """Weights of what the grammar puts out for one clause, and whether someone is addressed in it."""
    said, weights, state = lexicon.grammar.run([lexicon.symbol(w) for w in words])
    out = defaultdict(float)
    for symbol, weight in zip(said, weights):
        out[symbol] += weight
    return out, state[1] == "someone"


def text_features(text: str | None, lexicon: Lexicon, finder) -> np.ndarray:
    """Bias; plain, negated and reported insults (logs of their weights); addressed insults; plain threats with and without an addressee; insults to a hundred words."""
    low = (text or "").lower()
    x = np.zeros(len(PRIOR))
    x[0] = 1
    done, sums, addressed, threats, clear = -1, Counter(), 0, 0, 0
    # Clauses are found once, from left to right, as far as matches go.
    ends = chain((m.start() for m in _CLAUSE_END.finditer(low)), [len(low)])
    left, right = -1, -1
    for at, size in finder.iter(low):
        begin = at - size + 1
        if at < done or begin and low[begin - 1].isalpha():
            continue
        while right < at:
            left, right = right, next(ends)
        done = right
        out, someone = clause_outputs(_TOKEN.findall(low[left + 1 : done]), lexicon)
        sums.update(out)
        addressed += someone * out.get("insult", 0.0)
        threats += someone * out.get("threat", 0.0)
        clear += (not someone) * out.get("threat", 0.0)
    if done >= 0:
        reported = sum(v for k, v in sums.items() if k.startswith("reported"))
        words = 1 + low.count(" ")
        x[1:] = [np.log1p(sums["insult"]), np.log1p(sums["negated insult"]), np.log1p(reported), np.log1p(addressed), np.log1p(threats), np.log1p(clear), min(5.0, 100 * sums["insult"] / words)]
    return x


def learn_lexicon(toxic: list[str], clean: list[str], least: int = 3, most_terms: int = 500) -> Lexicon:
    """Terms that explain the toxic texts, weighted by their log odds.

    Terms are words, and stems that several words share. Greedily, the one that covers most toxic texts
    not yet explained, less a charge for the clean texts that hold it, joins the lexicon. Each seen form of
    a stem then has its own weight, drawn towards its stem's; unseen forms have the stem's.
    """
    toxic_words, clean_words = ([set(_WORD.findall(t.lower())) for t in texts] for texts in (toxic, clean))
    n_toxic, n_clean = max(1, len(toxic)), max(1, len(clean))
    stems_of = lambda words: {(1, w[:n]) for w in words for n in STEM_SIZES if len(w) >= n}
    had, harmless, forms = Counter(), Counter(), defaultdict(set)
    for words in toxic_words:
        had.update({(0, w) for w in words} | stems_of(words))
    had = Counter({t: n for t, n in had.items() if n >= least})
    for words in clean_words:
        harmless.update(t for t in {(0, w) for w in words} | stems_of(words) if t in had)
    charge = lambda t: 3 * harmless[t] / n_clean
    good = {t for t, n in had.items() if n / n_toxic > 4 * (harmless[t] + 0.5) / n_clean and n / n_toxic > charge(t)}
    for words in toxic_words:
        for w in words:
            for n in STEM_SIZES:
                if (1, w[:n]) in good:
                    forms[w[:n]].add(w)
    # A stem has several forms, and no single one makes up most of it.
    good = {t for t in good if not t[0] or len(forms[t[1]]) >= 3 and max(had[0, w] for w in forms[t[1]]) < 0.6 * had[t]}
    cover = defaultdict(set)
    for i, words in enumerate(toxic_words):
        for term in ({(0, w) for w in words} | stems_of(words)) & good:
            cover[term].add(i)
    chosen, left = [], set(range(len(toxic)))
    while cover and len(chosen) < most_terms:
        # Of equal gain the longer stem is preferred.
        term = max(cover, key=lambda t: (len(cover[t] & left) / n_toxic - charge(t), t[0], len(t[1]), t[1]))
        gain = cover[term] & left
        if len(gain) < least or len(gain) / n_toxic <= charge(term):
            break
        chosen.append(term)
        left -= gain
        cover = {t: ids & left for t, ids in cover.items() if t != term and len(ids & left) >= least}
    words, stems = {}, {}
    odds = lambda a, b, base=1.0: np.log((a / n_toxic + base / n_clean) / (b / n_clean + 1 / n_clean))
    of_form = Counter(w for ws in toxic_words for w in ws), Counter(w for ws in clean_words for w in ws)
    for is_stem, text in chosen:
        if not is_stem:
            words[text] = _weight(odds(of_form[0][text], of_form[1][text]))
            continue
        own = [w for w in of_form[0].keys() | of_form[1].keys() if w.startswith(text) and w != text]
        shared = odds(sum(of_form[0][w] for w in own), sum(of_form[1][w] for w in own))
        stems[text] = _weight(shared)
        for w in [*own, text]:
            words[w] = _weight(odds(of_form[0][w], of_form[1][w], np.exp(shared) if w != text else 1.0))
    for w in INSULT:
        # Known insults join unless the clean texts use them.
        if of_form[1][w] <= 0.002 * n_clean:
            words.setdefault(w, 1.0)
    return Lexicon(words, stems)


def _weight(odds: float) -> float:
    """Log odds of four or more count in full; none count below zero."""
    return float(min(1.0, max(0.0, odds / 4)))


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not hasattr(self, "_finder"):
            self._finder = self.lexicon.finder()
        x = np.array([text_features(t, self.lexicon, self._finder) for t in texts]).reshape(-1, len(PRIOR))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights}


def fit_weights(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior weights."""
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (importance * (y - p)) - ridge * (w - PRIOR)
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_per_class: int = 2500, sample_text_bytes: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most about ``sample_per_class`` labelled documents of each class, none of them longer than ``sample_text_bytes`` (documented bounds; chosen by a hash of the id).

    An id that is labelled in both ways counts as toxic. Scoring reads texts of any length.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    counts = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    texts: dict[int, list[str]] = {0: [], 1: []}
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for label, n in counts.items():
        chosen = marked.where((F.col("label") == label) & (unit < sample_per_class / n)).limit(2 * sample_per_class)
        # The chosen ids are bounded by the sample, so they may be broadcast.
        found = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= sample_text_bytes)).join(F.broadcast(chosen), id_col).select(id_col, text_col).limit(4 * sample_per_class).collect()
        texts[label] = [r[1] for r in sorted(found, key=lambda r: (r[0], r[1]))]
    lexicon = learn_lexicon(texts[1], texts[0])
    model = ToxicityModel(lexicon, PRIOR.copy())
    rows = texts[1] + texts[0]
    if texts[0] and texts[1]:
        finder = lexicon.finder()
        x = np.array([text_features(t, lexicon, finder) for t in rows])
        y = np.array([1.0] * len(texts[1]) + [0.0] * len(texts[0]))
        model.weights = fit_weights(x, y, np.ones(len(y)))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row.

    Null and empty texts match nothing and get the score of a text without matches. Repeated rows and null ids
    are kept as they come; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                score = held.value.scores(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
