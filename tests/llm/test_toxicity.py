"""The toxicity grammar: the composed machine against its parts in turn, features against a plain reading, long texts."""

import pickle
import random
import re
import time

import numpy as np
import pytest

from fieldweave.llm.toxicity import END, PRIOR, THREATS, Lexicon, ToxicityModel, clause_outputs, grammar, inflections, machines, text_features

LEXICON = Lexicon({"moron": 0.8, "mora": 0.3, "fool": 1.0, "fine": 0.0}, {"scum": 0.6, "idio": 0.9})


def test_composition_is_the_parts_in_turn():
    terms = {"a": 0.25, "b-": 0.75}
    parts, symbols = machines(terms)
    whole, r = grammar(terms), random.Random(1)
    for _ in range(500):
        clause = r.choices(symbols, k=r.randint(0, 14))
        said, weights, states = clause, [1.0] * len(clause), []
        for part in parts:
            said, own, state = part.run(said)
            weights = [a * b for a, b in zip(weights, own)]
            states.append(state)
        got = whole.run(clause)
        assert got[0] == said and got[1] == pytest.approx(weights) and got[2][1] == states[-1]


def _plain(text):
    """Features by reading every clause, without looking for matches first, and scopes by position instead of by machine."""
    low = (text or "").lower()
    sums, addressed, threats, clear = dict.fromkeys(("insult", "negated", "reported"), 0.0), 0.0, 0.0, 0.0
    for clause in re.split(r"[.!?;:\n]", low):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»]", clause)
        kinds = [LEXICON.symbol(w) for w in words]
        insult = threat = 0.0
        reported = quoted = False
        reach = 0
        for w, kind in zip(words, kinds):
            if kind == "quote":
                quoted, reported = not quoted, False
            elif kind == "speech" and not quoted:
                reported = True
            elif kind == "verb" or isinstance(kind, tuple):
                weight = 1.0 if kind == "verb" else {**LEXICON.words, **{f"{s}-": x for s, x in LEXICON.stems.items()}}[kind[1]]
                if reported or quoted:
                    sums["reported"] += weight
                elif reach and kind != "verb":
                    sums["negated"] += weight
                elif not reach and kind == "verb":
                    threat += weight
                elif not reach:
                    insult += weight
            reach = 3 if kind == "negation" else max(0, reach - 1)
        someone = "target" in kinds
        sums["insult"] += insult
        addressed, threats, clear = addressed + someone * insult, threats + someone * threat, clear + (not someone) * threat
    found = any(s == "verb" or isinstance(s, tuple) for s in map(LEXICON.symbol, re.findall(r"[^\W\d_]+", low)))
    x = [np.log1p(sums["insult"]), np.log1p(sums["negated"]), np.log1p(sums["reported"]), np.log1p(addressed), np.log1p(threats), np.log1p(clear), min(5.0, 100 * sums["insult"] / (1 + low.count(" ")))]
    return [1.0, *(x if found else [0.0] * 7)]


def test_features_against_a_plain_reading():
    r, finder = random.Random(2), LEXICON.finder()
    words = ["moron", "mora", "fool", "fine", "scumbag", "idiotic", "you", "not", "said", '"', "kill", "a", "day", "oxmoron", "never"]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "! ", "\n", ": "]) for _ in range(r.randint(0, 25)))
        assert text_features(text, LEXICON, finder) == pytest.approx(_plain(text)), text


def test_many_matches_take_linear_time():
    text = "You are a fool and a moron. " * 100_000
    began = time.process_time()
    score = ToxicityModel(LEXICON, PRIOR).scores([text, None, ""])
    assert time.process_time() - began < 20 and score[0] > 0.9 > 0.1 > score[1] == score[2]


def test_a_lexicon_travels():
    again = pickle.loads(pickle.dumps(LEXICON))
    assert clause_outputs(["you", "scumbag"], again) == clause_outputs(["you", "scumbag"], LEXICON) and any("kill" in stems for stems in THREATS)


@pytest.mark.parametrize(
    "text,threats",
    [
        ("I am killing you", 1), ("I will kill you", 1), ("he stabbed him", 1), ("ich töte dich", 1), ("sie haben dich umgebracht", 1), ("je te tue", 1), ("ils vont te frapper", 1),
        ("te voy a matar", 1), ("la destruyó ella", 1), ("tu es ici avec toi", 0), ("tu tournes", 0), ("the killer whale and you", 0), ("a burner for you", 0), ("you hang by a killjoy", 1), ("mats you", 0), ("mata a ellos", 1),
    ],
)
def test_threats_in_every_form(text, threats):
    """A stem with one of its endings is a threat, alone or within other words it is none."""
    lexicon = Lexicon({}, {})
    x = text_features(text, lexicon, lexicon.finder())
    assert (x[5] > 0) == bool(threats), x


def test_machine_of_letters_is_the_list_of_forms():
    machine = inflections({"tu frapp": "er e", "kill": " s ed", "shot": ""})
    reads = lambda w: machine.run([*w, END])[2] is True
    assert [w for w in ("tuer", "tue", "tu", "frappe", "frapp", "frapper", "kill", "kills", "killed", "killeds", "kil", "shot", "shots", "") if reads(w)] == ["tuer", "tue", "frappe", "frapper", "kill", "kills", "killed", "shot"]
