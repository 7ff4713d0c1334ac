"""Language identification: inference against enumeration, whole words, scripts without spaces."""

import random
from itertools import product

import numpy as np
import pytest

from fieldweave.llm import language_id as li


def _model(seed, labels="abc"):
    r = np.random.default_rng(seed)
    model = li.ChainModel(list(labels))
    model.weights = r.normal(0, 0.4, model.weights.shape).astype(np.float32)
    model.moves = r.normal(0, 1, model.moves.shape).astype(np.float32)
    return model


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_shares_are_those_of_all_labellings(monkeypatch, block):
    """Marginals over whole texts, however they are cut into blocks, against a sum over every labelling."""
    monkeypatch.setattr(li, "CHAIN", block)
    r, model = random.Random(block), _model(block)
    words = ["der", "die", "the", "and", "le", "une", "straße"]
    texts = [" ".join(r.choices(words, k=n)) for n in (1, 2, 3, 5, 7, 4, 6)] + ["", None]
    sums, counts = li.Labeller(model).shares(texts)
    assert counts.tolist() == [1, 2, 3, 5, 7, 4, 6, 0, 0]
    for text, got in zip(texts, sums):
        own = li.words_of(text)
        want, total = np.zeros(3), 0.0
        if own:
            e = model.emissions(li.features_of(own)).astype(float)
            for labels in product(range(3), repeat=len(own)):
                weight = np.exp(sum(e[t, y] for t, y in enumerate(labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:])))
                total += weight
                want += weight * np.bincount(labels, minlength=3)
            want /= total
        assert got == pytest.approx(want, abs=2e-3)


def test_long_texts_in_parts(monkeypatch):
    model = _model(9)
    text = "der die das und " * 3000
    whole = li.Labeller(model).shares([text])
    monkeypatch.setattr(li, "TEXT_AT_ONCE", 1000)
    parts = li.Labeller(model).shares([text])
    assert whole[1].tolist() == parts[1].tolist() == [12000] and np.allclose(whole[0], parts[0], rtol=1e-4)


def test_every_letter_is_read():
    """Words that agree in their first 24 letters differ, and no letter of a text without spaces is left out."""
    same = "donaudampfschifffahrtsge"
    one, two = (li.words_of(same + end) for end in ("sellschaft", "nossenschaft"))
    assert one != two and "".join(one) == same + "sellschaft" and max(map(len, one)) <= li.LETTERS
    for text in ("ภาษาไทยไม่มีช่องว่างระหว่างคำ", "日本語の文章には空白がない", "一二三四五"):
        assert "".join(li.words_of(text)) == text and len(li.words_of(text)) > 1
    assert li.words_of("Hello, monde　ici！déjà—vu 123 \U0001f600") == ["hello", "monde", "ici", "déjà", "vu"]


def test_unspaced_texts_are_told(spark):
    """Letters far from a text's beginning decide."""
    r = random.Random(4)
    thai, kana = "กขคงจฉชซ", "あいうえおかき"
    rows = [(k, "".join(r.choices(thai if k % 2 else kana, k=60)), "th" if k % 2 else "ja") for k in range(80)]
    model = li.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = "".join(r.choices(kana, k=60)) + "".join(r.choices(thai, k=400))
    assert [x[0] for x in li.Labeller(model).languages([mixed, mixed[::-1], "".join(r.choices(kana, k=40))])] == ["th", "th", "ja"]


def test_rare_labels_are_learned(spark):
    rows = [(k, "wort ding haus", f"l{k % 9}" if k < 30 else "de") for k in range(200)]
    assert len(li.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string")).labels) == 10


def test_every_letter_is_told():
    """Each code point of categories L* is a word by itself, and no other is without a letter beside it."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha()]
    assert not [c for c in letters if not li.words_of(c)]
    model = _model(3)
    told = li.Labeller(model).languages(["ℝ", "ⁿ", "々", "ℕ ℝ ℂ", "№ 5", "¹²", "", None, "†‡"])
    assert [t == li.UNDETERMINED for t, _ in told] == [False] * 4 + [True] * 5


def test_beam_of_few_labels_is_the_whole(monkeypatch):
    """Texts that weigh their own labels one by one get what all together give, while the beam holds all labels."""
    model, texts = _model(4, "abcde"), ["der die das und " * 30, "the and of", "", "le la une straße " * 9]
    whole = li.Labeller(model).shares(texts)[0]
    monkeypatch.setattr(li, "BEAM", 4)
    part = li.Labeller(model).shares(texts)[0]
    assert part.shape == whole.shape and ((part > 0).sum(1) <= 4).all() and np.allclose(part.sum(1), whole.sum(1), rtol=1e-3)
    assert (part.argmax(1) == whole.argmax(1)).all()


def test_a_hundred_labels(spark):
    """More labels than the beam: every one can be predicted."""
    r = random.Random(7)
    words = {k: ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouyäö") for _ in range(r.randint(2, 4))) for _ in range(60)] for k in range(100)}
    docs = [(i, " ".join(r.choices(words[i % 100], k=40)), f"l{i % 100:02d}") for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = li.train_language_model(frame.where("doc_id < 1500"))
    assert len(model.labels) == 100 and model.weights.nbytes < 100 << 20
    found = {x.doc_id: x.lang_pred for x in li.identify_languages(frame.where("doc_id >= 1500"), model).collect()}
    right = [found[i] == lang for i, _, lang in docs[1500:]]
    assert sum(right) > 0.95 * len(right) and {lang for i, _, lang in docs[1500:]} == {found[i] for i in found}
