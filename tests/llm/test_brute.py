"""Text operators against plain versions, exact round trips and held-out accuracy."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from fieldweave.llm import queries as q
from fieldweave.llm.decontaminate import decontaminate
from fieldweave.llm.exact_dedup import exact_dedup, merge_filters, segment_filters
from fieldweave.llm import graph, similar
from fieldweave.llm.graph import components
from fieldweave.llm.html_extract import extract_texts, train
from fieldweave.llm.language_id import Labeller, held_out, train_language_model
from fieldweave.llm.line_dedup import line_dedup
from fieldweave.llm.packing import layout
from fieldweave.llm.sharding import shard_by_bytes
from fieldweave.llm.simhash import fingerprint, linked, links, simhash_components
from fieldweave.llm.similar import CARRIED, _ranked, candidate_edges, forest, index_shape, meetings, most_bits, positions, rest_of_edges, similar_components
from fieldweave.llm.substring_dedup import repeated_passages

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path())


def texts_of(spark, folder=SMALL):
    return {r.doc_id: r.text for r in q.table(spark, folder, "documents").select("doc_id", "text").collect()}


@needs_tables
@pytest.mark.parametrize("name", q.ORACLES)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = q.QUERIES[name](spark, SMALL)
    want = con.sql(q.ORACLES[name]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@needs_tables
def test_simhash(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    prints = [brute.fingerprint(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute.components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in q.op1_simhash(spark, SMALL).collect()} == want


def _near(r, base, n, flips, window=64):
    return {base ^ sum(1 << b for b in set(r.sample(range(window), flips))) for _ in range(n)}


@pytest.mark.parametrize("window", [64, 24, 16])
def test_long_lists(spark, window):
    """Groups far beyond the length at which a posting list is divided lose no link and gain none."""
    r = random.Random(window)
    prints = list(set().union(*(_near(r, r.getrandbits(64), n, k, window) for n, k in ((5000, 8), (3000, 3), (40, 2), (1, 0)))))
    table = spark.createDataFrame([(0, p - (1 << 64) if p >> 63 else p) for p in prints], "t int, fp long")
    roots = {row.node & (1 << 64) - 1: row.root for row in components(links(table).select("a", "b")).collect()}
    a, group = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            group[max(x, y)] = min(x, y)
    mine, theirs = defaultdict(set), defaultdict(set)
    for i, p in enumerate(prints):
        mine[roots.get(p, f"alone {p}")].add(p)
        theirs[find(i)].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_linked_is_a_forest():
    fps = np.array([0, 1, 3, 1 << 40, 0xFF << 20], np.uint64)
    assert sorted(linked(fps, 3)) == [(0, 1), (0, 3), (0, 1 << 40)]


@needs_tables
def test_packing(spark, tokenizer):
    assert brute.check_packing(q.op2_packing(spark, SMALL).collect(), texts_of(spark), tokenizer) == 0


def test_packing_odd_texts(spark, tokenizer):
    odd = ["", " ", "<|endoftext|>a <|startoftext|>", "it's WE'LL I'm don't 'd", "a b c\u0085d", "İstanbul İ ß ẞ ﬁ Å Å", "日本語 テスト 한국어", "12345 6.7e-8", "éé", "\x00\x1c\x1d a\x1eb\x1fc", "�​‍👩‍👩‍👧", "x" * 50_000, "naïve café ÀÖØ", "Σίσυφος ΣΑΣ"]
    texts = dict(enumerate(odd * 3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    from fieldweave.llm.packing import pack

    assert brute.check_packing(pack(docs, q.tokenizer_path(), max_len=64).collect(), texts, tokenizer, 64) == 0


def test_packing_by_another_tokenizer(spark):
    """A file of other settings is not taken for the one whose pre-tokens are known."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from fieldweave.llm.packing import ChunkEncoder, pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert ChunkEncoder(q.tokenizer_path()).chunked and not ChunkEncoder(path).chunked
    texts = dict(enumerate(["Two words", "  It's\n\nUPPER 123", "", "x" * 3000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert brute.check_packing(pack(docs, path, max_len=64).collect(), texts, Tokenizer.from_file(path), 64) == 0


def test_layout():
    assert layout(4096 * 2 + 13, 4096).tolist() == [8192, 8200, 8204, 8205] and layout(8192, 4096).tolist() == [8192]


@pytest.mark.parametrize("bits, segment_bits, most", [(64, 4, 3), (36, 0, 3), (28, 5, 10**6), (16, 6, 400), (4, 1, 90), (3, 0, 7)])
def test_filters_merge_without_loss(bits, segment_bits, most):
    """Values and counts of partitions of any size come back from the packed filters, merged."""
    r = random.Random(bits)
    pool = [r.getrandbits(bits) for _ in range(400)]
    partitions = [[x for x in (r.choice(pool) for _ in range(size)) for _ in range(r.choice((1, 1, 1, 2, r.randint(1, most if size < 5 else 3))))] for size in (300, 1, 3, 900)]
    parts = defaultdict(list)
    for values in partitions:
        for k, f in segment_filters(np.array(values, np.uint64), bits, segment_bits):
            parts[k].append(f)
    got = {}
    for k, filters in parts.items():
        for v, c in zip(*merge_filters(filters)):
            got[k << (bits - segment_bits) | int(v)] = int(c)
    assert got == Counter(x for values in partitions for x in values)


def test_filters_are_smaller_than_rows():
    """Bytes of a filter for each fingerprint, at the bits that a corpus of a quarter of a million rows asks for."""
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 28, 8000).astype(np.uint64))
    size = sum(len(f.flags) + len(f.remainders) for _, f in segment_filters(values, 28, 4))
    print(f"{size / len(values):.2f} bytes a fingerprint")
    assert size < 4 * len(values)


def test_exact_dedup_with_clashing_fingerprints(spark):
    """Fingerprints of four bits make different texts clash; byte verification tells them apart."""
    r = random.Random(3)
    rows = [(i, r.choice("abcdefgh") * r.randint(1, 4) + " " * r.randint(0, 3)) for i in range(300)]
    got = {x.doc_id: x for x in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), fingerprint_bits=4).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.replace(" ", "")].append((-len(t), i))
    for i, t in rows:
        body = t.replace(" ", "")
        keep = min(groups[body])[1]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest())


def _passages(r):
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    text = lambda n: [word() for _ in range(n)]
    return word, text


def test_substring_dedup(spark):
    """Planted exact and fuzzy passages are found with their places; texts that share nothing long stay out."""
    r = random.Random(5)
    word, text = _passages(r)
    passage, short = text(80), text(20)
    fuzzy = [word() if k % 12 == 7 else w for k, w in enumerate(passage)]
    gap = passage[:40] + text(6) + passage[40:]
    rows = {1: text(200) + passage + text(50), 2: text(30) + passage + text(300), 3: text(10) + fuzzy + text(10), 4: text(90) + gap + text(20), 5: text(400), 6: short + text(100), 7: text(60) + short, 8: passage}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    found = defaultdict(list)
    for x in repeated_passages(docs).collect():
        found[x.doc_id].append(x)
    assert set(found) == {2, 3, 4, 8}
    for i, begin, end in ((2, 30, 110), (3, 10, 90), (4, 90, 176), (8, 0, 80)):
        assert min(x.start_word for x in found[i]) <= begin + 8 and max(x.end_word for x in found[i]) >= end - 8 and min(x.start_word for x in found[i]) >= begin - 8
        assert all(x.other_doc_id == 1 and abs(x.other_start - 200) <= 12 for x in found[i] if x.start_word <= begin + 8)


def _found(spark, rows):
    """{doc_id: [(start_word, end_word, other_doc_id)]} of lists of words by id."""
    docs, out = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string"), defaultdict(list)
    for x in repeated_passages(docs).collect():
        out[x.doc_id].append((x.start_word, x.end_word, x.other_doc_id))
    return {i: sorted(v) for i, v in out.items()}


def test_substring_dedup_cuts_chains_that_fail(spark):
    """Two exact passages side by side in one document and far apart in another are both reported."""
    text = _passages(random.Random(6))[1]
    one, two = text(100), text(100)
    for between in (60, 200):
        found = _found(spark, {1: text(50) + one + two + text(20), 2: text(30) + one + text(between) + two + text(30)})
        for begin in (30, 130 + between):
            assert any(abs(a - begin) <= 2 and abs(b - begin - 100) <= 2 for a, b, _ in found[2])


def test_substring_dedup_reports_every_place(spark):
    """A passage that stands twice in a document is reported at both places."""
    text = _passages(random.Random(7))[1]
    passage = text(80)
    found = _found(spark, {1: text(40) + passage + text(40), 2: text(50) + passage + text(270) + passage + text(30)})
    for begin in (50, 400):
        assert any(abs(a - begin) <= 2 and abs(b - begin - 80) <= 2 for a, b, _ in found[2])


@pytest.mark.parametrize("length, changed, least", [(60, 0.1, 0.99), (50, 0.15, 0.9), (60, 0.2, 0.9), (80, 0.2, 0.97), (45, 0.1, 0.93), (40, 0, 1)])
def test_substring_dedup_recalls_fuzzy_passages(spark, length, changed, least):
    """Passages with evenly drawn substitutions, each planted in two documents, are found at the identity that is promised."""
    r = random.Random(8)
    word, text = _passages(r)
    rows = {}
    for k in range(200):
        passage, fuzzy = text(length), None
        other = set(r.sample(range(1, length - 1), round(changed * length)))
        fuzzy = [word() if i in other else w for i, w in enumerate(passage)]
        rows |= {2 * k: text(30) + passage + text(30), 2 * k + 1: text(40) + fuzzy + text(20)}
    found = _found(spark, rows)
    assert sum(any(o == 2 * k for _, _, o in found.get(2 * k + 1, [])) for k in range(200)) >= least * 200


def test_substring_dedup_past_common_phrases(spark):
    """Unrelated earlier documents that hold every phrase of a passage do not hide that two later ones share it."""
    text = _passages(random.Random(10))[1]
    passage = text(60)
    rows = {k: text(30) + passage[k : k + 6] + text(30) for k in range(55)}
    found = _found(spark, rows | {100: text(40) + passage + text(30), 101: text(20) + passage + text(50)})
    assert set(found) == {101} and any(o == 100 and a <= 22 and b >= 78 for a, b, o in found[101])


def test_substring_dedup_repetitive_texts(spark):
    """A text of few words over and over and its copy take linear time."""
    text = _passages(random.Random(9))[1]
    turning = text(9) * 20_000
    found = _found(spark, {3: turning, 4: turning + text(20)})
    assert min(a for a, _, _ in found[4]) == 0 and max(b for _, b, _ in found[4]) >= 180_000


def test_substring_dedup_ranges_follow_the_corpus(spark, monkeypatch):
    """More words, more ranges; however many there are, the passages found are the same."""
    from fieldweave.llm import substring_dedup as s

    assert [s.range_bits(n) for n in (0, 1 << 31, 1 << 34, 1 << 44)] == [12, 12, 15, 25]
    text = _passages(random.Random(12))[1]
    passage = text(80)
    rows = {k: text(20 + k) + passage[k:] + text(30) for k in range(12)}
    few = _found(spark, rows)
    assert set(few) == set(range(1, 12))
    monkeypatch.setattr(s, "RANGE_BITS", (22, 30))
    assert _found(spark, rows) == few


def test_substring_dedup_carries_stretches_only(spark):
    """Passages far inside long texts, at places of both that differ, are aligned as if the texts were whole."""
    text = _passages(random.Random(13))[1]
    passage = text(700)
    found = _found(spark, {1: text(5_000) + passage + text(3_000), 2: text(9_000) + passage + text(10)})
    assert [(a, b, o) for a, b, o in found[2]] == [(9_000, 9_700, 1)]


@needs_tables
def test_substring_dedup_finds_every_long_copy(spark):
    """Each document with 50 consecutive words of an earlier one is reported; those without 20 are not."""
    texts, first = texts_of(spark), {50: {}, 20: {}}
    want = {50: set(), 20: set()}
    for i in sorted(texts):
        w = brute.words(texts[i])
        for n, seen in first.items():
            for p in range(len(w) - n + 1):
                if seen.setdefault(tuple(w[p : p + n]), i) != i:
                    want[n].add(i)
    got = {r.doc_id for r in q.op4_substring_dedup(spark, SMALL).collect()}
    assert want[50] <= got
    assert got <= want[20]


def test_sharding_subdivides_overfull_ranges(spark):
    """Ranges of more than twice their share, as few splitters leave them, are cut again; equal texts stay in one part."""
    from pyspark.sql import functions as F

    from fieldweave.llm.sharding import _subdivided

    r = random.Random(12)
    rows = [(i, r.randint(1, 200), hash_, 0 if i < 6000 else 1 + i % 50, None, 0) for i in range(8000) for hash_ in [r.randrange(-(1 << 63), 1 << 63) if i % 4 else 77 + i % 40]]
    placed = spark.createDataFrame(rows, "doc_id long, size long, key long, range long, hot_key long, piece long")
    target = sum(x[1] for x in rows) // 100
    got = _subdivided(placed, target, 32).collect()
    totals, parts = defaultdict(int), defaultdict(set)
    for x in got:
        totals[x["range"], x.part] += x["size"]
        parts[x["range"], x.key].add(x.part)
    assert len(got) == 8000 and all(len(p) == 1 for p in parts.values())
    # The texts 77 to 116 are 1,500 neighbouring records: of about a share each at most.
    assert max(totals.values()) <= 3 * target and sum(k[0] == 0 for k in totals) >= 40
    assert {k for k in totals if k[0]} == {(n, 0) for n in range(1, 51)}
    whole = shard_by_bytes(placed.select("doc_id", F.col("key").cast("string").alias("text")), ranges=256, sample_per_range=1).collect()
    by_shard = defaultdict(int)
    for x in whole:
        by_shard[x.shard] += x["size"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 4 * sum(by_shard.values()) // 256
    assert all(sorted(x.slot for x in whole if x.shard == k) == list(range(sum(x.shard == k for x in whole))) for k in by_shard)


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, hot):
    r = random.Random(11)
    rows = [(i, "hot text " * 40 if hot and i % 3 == 0 else "é" * r.randint(0, 900) if i % 10 else "same") for i in range(4000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), ranges=256).collect()
    text, by_shard, of_text = dict(rows), defaultdict(list), defaultdict(set)
    for x in got:
        raw = text[x.doc_id].encode()
        assert x["size"] == len(raw) + 1 and x.text_crc32 == zlib.crc32(raw) and x.law == "bytes" and x.grown_shard is None
        by_shard[x.shard].append(x)
        of_text[text[x.doc_id]].add(x.shard)
    assert len(got) == 4000 and sorted(by_shard) == list(range(8))
    assert all(sorted(x.slot for x in xs) == list(range(len(xs))) for xs in by_shard.values())
    sizes = [sum(x["size"] for x in xs) for xs in by_shard.values()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)
    assert len(of_text["same"]) == 1


@needs_tables
def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in q.table(spark, MIDDLE, "labels").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in q.op6_toxicity(spark, MIDDLE).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.9
    assert np.mean([p for _, y, p in rows if not y]) < 0.02 and np.mean([p for _, y, p in rows if y]) > 0.8


def test_toxicity_grammar(spark):
    """Negated and reported insults weigh less than plain ones, addressed ones most."""
    from fieldweave.llm.toxicity import PRIOR, Lexicon, ToxicityModel

    model = ToxicityModel(Lexicon({"moron": 1.0}, {}), PRIOR)
    said = ["You are a moron.", "A moron.", "You are not a moron.", 'They said "what a moron".', "A fine day."]
    score = dict(zip(said, model.scores(said)))
    assert score[said[0]] > score[said[1]] > score[said[2]] and score[said[1]] > score[said[3]] > score[said[4]]


@needs_tables
def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in q.table(spark, MIDDLE, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in q.op8_language_id(spark, MIDDLE).collect() if r.held_out]
    assert len(rows) > 150 and np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    model = train_language_model(q.table(spark, MIDDLE, "documents").where(~held_out(F.col("doc_id"), 4, 2)))
    assert [x[0] for x in Labeller(model).languages(["the and of that the with", "der und die nicht", "", "123"])] == ["en", "de", "und", "und"]


@needs_tables
@pytest.mark.parametrize("how", [{}, {"table_bytes": 60_000}, {"carry": True}, {"carry": True, "table_bytes": 30_000}])
def test_decontamination(spark, how):
    texts = texts_of(spark)
    items = [(r.item_id, r.text) for r in q.table(spark, SMALL, "benchmark").collect()] + [(900, "Short item"), (901, None), (902, "..")]
    texts[10**6] = "x " + items[0][1] + " a short ITEM, " + items[3][1]
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(docs, bench, **how).collect()}
    want = brute.decontaminate(list(texts.items()), items)
    assert got == want and want[10**6][2] >= 3


def test_html():
    """Hand-made pages: the article and nothing beside it."""
    model = train(400)
    story = "The committee met on Tuesday, and after a long debate, it agreed on a budget for the coming year. "
    pages = {
        f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>Budget &amp; talks</h1><p>{story * 3}</p><p>{story}<br>Short</p></article><footer>&copy; Example</footer></body></html>": f"Budget & talks {story * 3}{story}Short",
        f"<div class=sidebar><a href=/a>Related</a><a href=/b>More</a></div><main><p>{story * 2}<script>var x='<p>no</p>'</script></p><p>{story * 2}</p></main><div class='comments'><p>I like it.</p></div>": (story * 4).strip(),
        "": "",
        None: "",
    }
    assert extract_texts(list(pages), model) == [p.strip() for p in pages.values()]


@needs_tables
def test_html_keeps_articles(spark):
    rows = {r.page_id: r.text for r in q.op10_html_extraction(spark, SMALL).collect()}
    for p in q.table(spark, SMALL, "pages").collect():
        if "<article>" in p.html and "<footer>" in p.html and p.html.count("<article>") == 1:
            foot = " ".join(p.html.rsplit("<footer>", 1)[1].split("</footer>")[0].replace("&copy;", "©").replace("&middot;", "·").split())
            assert foot not in rows[p.page_id]
    assert all(rows.values())


def test_simhash_tables(spark):
    """Several fingerprints a text link what any of them links, against all pairs."""
    r = random.Random(14)
    word, text = _passages(r)
    rows, base = {}, [text(150) for _ in range(20)]
    for i in range(120):
        rows[i] = " ".join(word() if r.random() < 0.02 * (i % 3) else w for w in base[i % 20])
    prints = {i: fingerprint(t, 5, 6) for i, t in rows.items()}
    group = {i: i for i in rows}
    for i in rows:
        for j in rows:
            if group[i] != group[j] and any((a ^ b).bit_count() <= 3 for a, b in zip(prints[i], prints[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    got = {x.doc_id: x.component_id for x in simhash_components(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), words=5, tables=6).collect()}
    assert got == group and len(set(group.values())) < 100


def test_similar_components(spark):
    """No link below the stated similarity, and the share of planted pairs that is found at each similarity above it."""
    r = random.Random(15)
    word, text = _passages(r)
    rows = {}
    for i in range(400):
        words = text(150)
        rows[2 * i] = " ".join(words)
        for _ in range(i % 8):
            words[r.randrange(len(words))] = word()
        rows[2 * i + 1] = " ".join(words)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar_components(docs).collect()}
    found = defaultdict(list)
    for i in range(400):
        alike = brute.likeness(brute.word_shingles(rows[2 * i]), brute.word_shingles(rows[2 * i + 1]))
        found[min(int(alike * 20 + 1e-9), 18) / 20].append(got[2 * i] == got[2 * i + 1])
    share = {s: sum(x) / len(x) for s, x in found.items()}
    assert all(share[s] == 0 for s in share if s < 0.8) and min(share) < 0.75, share
    assert share[0.8] >= 0.9 and share[0.85] >= 0.97 and share[0.9] == 1.0 and len(found[0.8]) > 30, share
    assert all(k // 2 == v // 2 for k, v in got.items())


@pytest.mark.parametrize("similarity", [0.8, 0.55])
def test_no_similar_pair_is_left_out(spark, similarity):
    """Pairs of each similarity around the stated one, exactly at it too, and chains of them, against all pairs."""
    r = random.Random(21)
    word, text = _passages(r)
    common, rows = " ".join(text(12)), []
    for i in range(260):
        words = text(r.choice((9, 30, 64, 150)))
        for _ in range(r.choice((2, 2, 3))):
            rows.append(f"{' '.join(words)} {common}" if i % 3 == 0 else " ".join(words))
            for _ in range(max(1, round(len(words) * r.choice((0.015, 0.02, 0.03, 0.06))))):
                words[r.randrange(len(words))] = word()
    # Sets of which the larger holds the smaller, and that have exactly one of the similarities.
    for whole, part in ((20, 16), (20, 11), (5, 4), (100, 55), (100, 80)):
        words = text(whole + 4)
        rows += [" ".join(words), " ".join(words[: part + 4])]
    want = brute.similar(rows, least=similarity)
    got = {x.doc_id: x.component_id for x in similar_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), similarity=similarity).collect()}
    assert got == dict(enumerate(want)) and 300 < len(set(want)) < len(rows) - 50


def test_the_rest_of_an_empty_index(spark, monkeypatch):
    """What the index leaves out is found: with no candidates of the index at all, the groups are those of all pairs."""
    monkeypatch.setattr("fieldweave.llm.similar.candidate_edges", lambda classes, *shape: classes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("apart")).limit(0))
    monkeypatch.setattr(rest_of_edges, "__defaults__", (8,))
    r = random.Random(22)
    word, text = _passages(r)
    base, rows = text(100), []
    for i in range(150):
        words = list(base) if i % 3 else text(100)
        for _ in range(r.choice((0, 1, 2, 3))):
            words[r.randrange(len(words))] = word()
        rows.append(" ".join(words))
    got = {x.doc_id: x.component_id for x in similar_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = brute.similar(rows)
    assert got == dict(enumerate(want)) and 50 < len(set(want)) < 100


def test_pairs_of_the_rest_go_out_once(spark, monkeypatch):
    """Pairs that meet in many lists go out about once, and pairs whose own first shingles tell that they are less similar not at all."""
    made = []

    def counted(held, met, schema, whole=similar._whole_lists):
        out = whole(held, met, schema)
        if schema == "a long, b long":
            out = out.localCheckpoint()
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr("fieldweave.llm.similar._whole_lists", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    r = random.Random(23)
    word, text = _passages(r)
    rows = []
    # Groups of twelve that share five sixths of the larger text, pairwise seven tenths of all shingles, and long texts with a passage in common.
    for _ in range(3):
        shared = text(500)
        rows += [" ".join(shared + text(100)) for _ in range(12)]
    rows += [" ".join(text(1500) + rows[0].split()[:60]) for _ in range(12)]
    try:
        got = {x.doc_id: x.component_id for x in similar_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(enumerate(brute.similar(rows)))
    (went, pairs), = made
    assert pairs <= 3 * 66 and went <= 2 * pairs, made


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr("fieldweave.llm.graph._small_star", lambda state, step=graph._small_star: rounds.append(1) or step(state))
    stars = spark.createDataFrame([(1, 5), (6, 1), (2, 9)], "a long, b long")
    assert sorted(map(tuple, components(stars).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)] and not rounds
    more = spark.createDataFrame([(9, 6), (9, 5), (7, 8), (8, 5), (3, 4)], "a long, b long")
    want = [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1)]
    assert sorted(map(tuple, graph.joined(components(stars), more).collect())) == want and rounds
    assert sorted(map(tuple, graph.joined(components(stars), more.limit(0)).collect())) == sorted(map(tuple, components(stars).collect()))


def test_similar_groups_do_not_depend_on_blocks(spark, monkeypatch):
    """A large group of near copies, by lists in blocks of 8 members and whole, equals all pairs."""
    r = random.Random(16)
    word, text = _passages(r)
    base, rows = text(120), []
    for i in range(120):
        words = list(base)
        for _ in range(r.choice((0, 1, 2, 9))):
            words[r.randrange(len(words))] = word()
        rows.append(" ".join(words))
    want = brute.similar(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for block in (1024, 8):
        monkeypatch.setattr(candidate_edges, "__defaults__", (block,))
        got = {x.doc_id: x.component_id for x in similar_components(docs).collect()}
        assert got == dict(enumerate(want)) and len(set(want)) > 3


def test_shape_of_the_index():
    """Lists do not grow with the corpus, sets of positions hardly overlap, and one pair in twenty at 0.8 is left out by counting bits."""
    for texts, width in ((10, 2), (8 << 20, 2), (9 << 20, 3), (1 << 31, 3), (1 << 33, 4)):
        got, tables = index_shape(texts, 0.8)
        sets = positions(width)
        assert got == width and len(sets) == {2: 4, 3: 8, 4: 14}[width] and {len(s) for s in sets} == {width}
        assert max(len(set(a) & set(b)) for a in sets for b in sets if a != b) == width - 2
        meets = (1 - np.arccos(1.6 / 1.8) / np.pi) ** (8 * width)
        assert (1 - meets) ** (tables * len(sets)) <= 0.05 < (1 - meets) ** ((tables - 1) * len(sets))


@pytest.mark.parametrize("width", [3, 4])
def test_wider_lists_find_as_much(spark, monkeypatch, width):
    """The index of a larger corpus, forced on a small one."""
    monkeypatch.setattr("fieldweave.llm.similar.index_shape", lambda texts, similarity: (width, index_shape(1 << (8 * width + 6), similarity)[1]))
    r = random.Random(19)
    word, text = _passages(r)
    rows = []
    for _ in range(60):
        words = text(120)
        rows.append(" ".join(words))
        for _ in range(2):
            words[r.randrange(len(words))] = word()
        rows.append(" ".join(words))
    got = {x.doc_id: x.component_id for x in similar_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    alike = [brute.likeness(brute.word_shingles(rows[2 * i]), brute.word_shingles(rows[2 * i + 1])) >= 0.8 for i in range(60)]
    assert sum(a and got[2 * i] == got[2 * i + 1] for i, a in enumerate(alike)) >= 0.9 * sum(alike) > 30 and all(k // 2 == v // 2 for k, v in got.items())


def test_ranks_of_lists(spark):
    r = random.Random(17)
    rows = [(r.choice((1, 1, 1, r.randrange(300))), k) for k in range(2000)]
    frame = spark.createDataFrame(rows, "list long, node long")
    want = defaultdict(list)
    for of, node in sorted(rows):
        want[of].append(node)
    want = sorted((of, node, k) for of, nodes in want.items() if len(nodes) > 1 for k, node in enumerate(nodes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, _ranked(frame).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_bits_are_no_proof(spark):
    """A text that repeats one shingle far more often than others has the bits of that shingle alone."""
    rows = [(1, "one two three four five"), (2, "one two three four five six seven eight nine ten " + "one two three four five " * 40)]
    got = {x.doc_id: x.component_id for x in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


def test_near_dedup_takes_one_text_an_id(spark):
    """The text of an id is chosen before groups are formed, and its row's other columns come along."""
    r = random.Random(18)
    _, text = _passages(r)
    a, b = " ".join(text(60)), " ".join(text(200))
    rows = [(3, a, "x"), (5, a + " and five words more now", "y"), (5, b, "z"), (7, b + " tail", "w"), (None, a, "n"), (9, a, "v"), (9, a, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Best string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4]], key=str)


def test_lists_of_wide_fingerprints():
    """Short and long lists in one batch against all pairs of each."""
    r = np.random.default_rng(1)
    for _ in range(20):
        fps = r.integers(0, 1 << 63, (80, 3)).astype(np.uint64)
        cuts = np.array([0, *sorted(r.choice(np.arange(1, 80), 5, replace=False)), 80])
        near = {(i, j) for a, b in zip(cuts, cuts[1:]) for i in range(a, b) for j in range(i + 1, b) if sum(int(x).bit_count() for x in fps[i] ^ fps[j]) <= 84}
        got = {tuple(sorted(x)) for x in meetings(np.arange(80), fps, cuts, 84).T.tolist()}
        trees = lambda edges: _partition(80, edges)
        assert trees(got) == trees(near)
    assert forest(fps[:1], 84) == []


def _partition(n, edges):
    group = list(range(n))
    for a, b in edges:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = [new if g == old else g for g in group]
    return group


@needs_tables
def test_pipeline(spark, tokenizer):
    """Stage by stage against plain versions; the model's decision on a text is the operator's own, made outside Spark."""
    docs = q.table(spark, SMALL, "documents")
    model = train_language_model(docs)
    texts = texts_of(spark)
    told = dict(zip(texts, Labeller(model).languages(list(texts.values()))))
    texts = {i: t for i, t in texts.items() if told[i][0] != "und" and told[i][1] >= corpus_pipeline.LEAST_CONFIDENCE}
    texts = brute.line_dedup(list(texts.items()))
    ids = sorted(texts)
    width, tables = index_shape(len(ids), corpus_pipeline.SIMILARITY)
    prints = [fingerprint(texts[i], 5, tables) for i in ids]
    same = [[[x >> 8 * p & 0xFF for p in range(8)] for x in fps] for fps in prints]

    def meet(i, j):
        near = sum((x ^ y).bit_count() for x, y in zip(prints[i][:CARRIED], prints[j][:CARRIED])) <= most_bits(corpus_pipeline.SIMILARITY, CARRIED)
        return near and any(all(x[p] == y[p] for p in triple) for x, y in zip(same[i], same[j]) for triple in positions(width))

    near = brute.similar([texts[i] for i in ids], meet)
    # Texts without words are one group.
    blank = [i for i in ids if not (texts[i] or "").strip(" \t\n\v\f\r")]
    texts = {i: texts[i] for k, i in enumerate(ids) if near[k] == k and i not in blank[1:]}
    hits = brute.decontaminate(list(texts.items()), [(r.item_id, r.text) for r in q.table(spark, SMALL, "benchmark").collect()])
    texts = {i: t for i, t in texts.items() if not hits[i][1]}
    assert len(texts) > 100
    assert brute.check_packing(corpus_pipeline.run(spark, SMALL).collect(), texts, tokenizer) == 0


def test_decontamination_of_long_batches(spark):
    """Texts that come to several times what is searched at once, where the second part starts with a text that overlaps the first."""
    long = "plain words that no item holds " * 180_000
    rows = [(i, long + "a b c d e f g h i j" * (i % 2), "en", "s", i) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    bench = spark.createDataFrame([("q", "a b c d e f g h i j")], "item_id string, text string")
    kept = decontaminate(docs, bench, carry=True).where("NOT contaminated")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 2]
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate(docs, bench).select("doc_id", "n_hit").collect()) == [(0, 0), (1, 10), (2, 0), (3, 10)]


def test_common_words_in_order():
    """Bit rows against the plain table."""
    from fieldweave.llm.substring_dedup import _agree

    r = random.Random(12)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 150))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert _agree(np.array(a, np.uint32), np.array(b, np.uint32)) == row[-1]


def test_line_dedup_long_texts(spark):
    """A hundred thousand lines of which half repeat, and a text that loses every line."""
    lines = [f"line {k}" for k in range(50_000)]
    rows = [(1, "\n".join(lines + lines)), (2, "\n".join(lines)), (3, "\n".join(["own", *lines[:100], "end", "of", "it"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.text, r.n_lines_in, r.n_lines_removed) for r in line_dedup(docs).collect()}
    assert time.time() - began < 30
    assert got == {1: (rows[1][1], 100_000, 50_000), 2: ("", 50_000, 50_000), 3: ("own\nend\nof\nit", 104, 100)}


def test_sharding_splits_a_hot_text_by_row(spark):
    """Copies of one text under one id, or none, are spread like any others."""
    rows = [(None if i % 2 else 7, "hot text " * 40) for i in range(3000)] + [(i, "text %d " % i * 9) for i in range(3000)]
    sizes = Counter()
    for x in shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), ranges=256).collect():
        sizes[x.shard] += x["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sizes.total()
