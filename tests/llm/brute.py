"""Plain versions of the text operators, for small inputs, and the rows that every operator must bear."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "very long words of one text that goes on " * 60_000
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \t\n", None, None, None),
    (4, "Tie one two three four five six", "en", "s", 31),
    (5, "Tie one two three four five six", "en", "s", 31),
    (5, "Tie one two three four five six", "en", "s", 31),
    (6, LONG, "en", "s", len(LONG)),
    (7, "a\nb\nc\nd\na\nb\nc", None, "s", 13),
    (8, "x\na\nb\nc\n", "de", "s", 8),
    (9, "éß  \U0001f600 \x00 1234 !?", "fr", "s", 14),
    (None, "no id at all here", "en", "s", 17),
    (None, None, None, None, None),
]
#: Names that the operators use themselves.
CLASHING = "fp part ids key size cell range piece h rep pos gone lines w h1 row_key n_words score label lang_score component_id keep_id law shard item html url N_Lines_In N_Hit Lang_Pred Contaminated Doc_Tokens Kept".split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def word_shingles(text, words=5):
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    return {" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def similar(texts, meet=lambda i, j: True, least=0.8):
    """For each text the least index it is linked to, over all pairs that ``meet`` and have this share of their five-word shingles in common."""
    sets, root = [word_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if likeness(a, sets[j]) >= least and root[i] != root[j] and meet(i, j):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def components(prints, bits=3):
    """For each fingerprint of a list the least index it is linked to."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def line_dedup(rows):
    """{id: text} of (id, text) rows, ids distinct."""
    first, gone = {}, defaultdict(set)
    for doc, text in sorted(rows):
        lines = (text or "").split("\n")
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if all(not x.strip(" ") for x in window):
                continue
            if window in first:
                gone[doc].update((p, p + 1, p + 2))
            first.setdefault(window, (doc, p))
    return {doc: text if not gone[doc] else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc]) for doc, text in rows}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def decontaminate(docs, items, width=10):
    """{id: (n_words, n_hit, n_items, items_sha256)} of (id, text) rows against (item, text) rows."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[p : p + m])].add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit.update(range(p, p + m))
                    found |= windows[tuple(w[p : p + m])]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def check_packing(rows, texts, tokenizer, max_len=4096):
    """Holds the pieces of a packing against whole texts encoded at once; ``texts`` are those of all rows by id, ids distinct."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = ids[d][at : at + p["length"]]
            assert p["start"] == at and p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p["length"]
        assert at == len(ids[d])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= max_len
        padding += 0 if at & (at - 1) == 0 else max_len - at
    return padding
