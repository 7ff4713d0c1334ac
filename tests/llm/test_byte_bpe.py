"""Byte-level BPE against the public library, round trips and odd rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from brute import CLASHING, ODD, SCHEMA
from fieldweave.llm.byte_bpe import FREE, Merger, decode, encode, round_trip, starts, states_before
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "²", "a", "É", "日", "!", "?", "''", "😀", "́", "\x1c", "\x85", "\x00"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merger():
    return Merger(PATH)


def agree(merger, library, texts):
    ids, counts = merger.encode(pa.array(texts, pa.string()))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == library.encode_ordinary(text or ""), (text or "")[:80]
    assert merger.decode(ids)[0] == "".join(t or "" for t in texts).encode()


def test_random_texts(merger, library):
    dice = random.Random(1)
    for _ in range(60):
        agree(merger, library, ["".join(dice.choice(PARTS) for _ in range(dice.randint(0, 40))) for _ in range(40)])


def test_every_code_point(merger, library):
    """Each code point after a letter, a number, a sign and a blank, so classes are those of the library."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    agree(merger, library, ["".join(before + c for c in points[k : k + 20_000]) for k in range(0, len(points), 20_000) for before in "a1! "])


def test_long_pieces(merger, library):
    agree(merger, library, [None, "", "a" * 5000, "ab" * 3000, " " * 700, "'" * 501 + "s", "<|endoftext|> is text"])


def test_scan_is_the_machine_step_by_step():
    dice = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 5000):
        functions = dice.integers(0, 8, (n, 8)).astype(np.uint8)
        state, want = FREE, []
        for f in functions:
            want.append(state)
            state = f[state]
        assert states_before(functions).tolist() == want


def test_a_text_starts_afresh():
    """Texts end to end are cut as each by itself."""
    texts = ["a ", "b", "'", "s ", " c", "'", "ve"]
    points, firsts = np.array([ord(c) for c in "".join(texts)], np.uint32), np.array([k == 0 for t in texts for k in range(len(t))])
    alone = np.concatenate([starts(np.array([ord(c) for c in t], np.uint32), np.arange(len(t)) == 0) for t in texts])
    assert starts(points, firsts).tolist() == alone.tolist()


def test_forgetting_changes_nothing(merger, library, monkeypatch):
    monkeypatch.setattr("fieldweave.llm.byte_bpe.CACHE_PIECES", 3)
    agree(merger, library, ["one two three four", "five six one two"])
    agree(merger, library, ["two three seven"])


def test_rows(spark, library):
    docs = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("own").alias(c) for c in [*CLASHING, "n_tokens", "IDS"]])
    got = sorted(map(tuple, round_trip(docs, PATH).collect()), key=str)
    want = []
    for doc, text, *_ in ODD:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert round_trip(docs.where("false"), PATH).collect() == []


def test_ends_of_tokens(spark, merger):
    rows = [(1, "été is summer"), (2, ""), (3, "x")]
    tokens = encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, with_ends=True)
    for (_, text), row in zip(rows, tokens.collect()):
        ids, ends = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.ends, "<i8")
        spans = [text.encode()[a:b] for a, b in zip([0, *ends], ends)]
        assert spans == [merger.decode(ids[k : k + 1])[0] for k in range(len(ids))] and len(ids) == row.n_tokens
    assert [bytes(r.bytes).decode() for r in decode(tokens, PATH).collect()] == [t for _, t in rows]


def test_query_over_the_table(spark, library):
    from fieldweave.llm.queries import op13_byte_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_tokens == len(library.encode_ordinary(docs[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
