"""Registered queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.byte_bpe import round_trip
from fieldweave.llm.decontaminate import decontaminate
from fieldweave.llm.exact_dedup import exact_dedup
from fieldweave.llm.html_extract import extract_main_text
from fieldweave.llm.language_id import held_out, identify_languages, train_language_model
from fieldweave.llm.line_dedup import line_dedup
from fieldweave.llm.packing import pack
from fieldweave.llm.sharding import shard_by_bytes
from fieldweave.llm.simhash import simhash_components
from fieldweave.llm.spelling import group_variants
from fieldweave.llm.substring_dedup import repeated_passages
from fieldweave.llm.toxicity import score_toxicity, train_toxicity
from fieldweave.llm.vector_codes import compress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, max_bits=3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), max_len=4096, end_id=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    model = train_toxicity(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    return score_toxicity(docs, model, threshold=0.7).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_in", "n_lines_removed")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train_language_model(docs.where(~out))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, every=199)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}

def _simhash_sql(words: int = 3, max_bits: int = 3, seed: int = 42) -> str:
    """XXH64 of each shingle in arithmetic modulo 2^64, bits by sums, links by all pairs of fingerprints.

    To turn a word by r bits is to multiply it by 2^r modulo 2^64 - 1.
    """
    # The five primes of XXH64 (fixed values).
    p1, p2, p3, p4, p5 = (f"{v}::UHUGEINT" for v in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m, less = f"{1 << 64}::UHUGEINT", f"{(1 << 64) - 1}::UHUGEINT"
    turn = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {less})"
    mixed = lambda acc, lane: f"({turn(f'({acc} + {lane} * {p2} % {m}) % {m}', 31)} * {p1} % {m})"
    # Bytes at a place (from 0) of the shingle, of which the first counts least.
    lane = lambda at, n: "('0x' || " + " || ".join(f"hx[2 * ({at} + {k}) + 1:2 * ({at} + {k}) + 2]" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    start = [(seed + 11400714785074694791 + 14029467366897019727) % (1 << 64), (seed + 14029467366897019727) % (1 << 64), seed, (seed - 11400714785074694791) % (1 << 64)]
    run = lambda first, ns, value, step: f"list_reduce(list_prepend({first}, list_transform({ns}, lambda i: {value})), lambda a, b: {step})"
    quarters = ", ".join(f"{run(f'{v}::UHUGEINT', 'range(n // 32)', lane(f'(32 * i + {8 * k})', 8), mixed('a', 'b'))} AS v{k}" for k, v in enumerate(start))
    merged = f"({' + '.join(turn(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18)))}) % {m}"
    for k in range(4):
        merged = f"(xor({merged}, {mixed('0::UHUGEINT', f'v{k}')}) * {p1} % {m} + {p4}) % {m}"
    eights = run("h", "range(n % 32 // 8)", lane("(n // 32 * 32 + 8 * i)", 8), f"({turn('xor(a, ' + mixed('0::UHUGEINT', 'b') + ')', 27)} * {p1} % {m} + {p4}) % {m}")
    four = f"CASE WHEN n % 8 >= 4 THEN ({turn(f'xor(h, {lane("(n // 8 * 8)", 4)} * {p1} % {m})', 23)} * {p2} % {m} + {p3}) % {m} ELSE h END"
    ones = run("h", "range(n % 4)", lane("(n // 4 * 4 + i)", 1), f"{turn(f'xor(a, b * {p5} % {m})', 11)} * {p1} % {m}")
    bits = " + ".join(f"CASE WHEN 2 * sum(c * CAST((h >> {b}) & 1 AS BIGINT)) > sum(c) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingled AS MATERIALIZED (
  SELECT doc_id, array_to_string(w[p:p + {words - 1}], ' ') AS s, count(*) AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS p FROM d WHERE len(w) > 0) GROUP BY ALL
), raw AS (
  SELECT s, hex(encode(s)) AS hx, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingled)
), striped AS (
  SELECT s, hx, n, {quarters} FROM raw
), h0 AS (
  SELECT s, hx, n, ((CASE WHEN n >= 32 THEN {merged} ELSE ({seed} + {p5}) % {m} END) + n::UHUGEINT) % {m} AS h FROM striped
), h1 AS (SELECT s, hx, n, {eights} AS h FROM h0
), h2 AS (SELECT s, hx, n, {four} AS h FROM h1
), h3 AS (SELECT s, {ones} AS h FROM h2
), h4 AS (SELECT s, xor(h, h // {1 << 33}::UHUGEINT) * {p2} % {m} AS h FROM h3
), h5 AS (SELECT s, xor(h, h // {1 << 29}::UHUGEINT) * {p3} % {m} AS h FROM h4
), hashed AS (SELECT s, CAST(xor(h, h // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM h5
), told AS (
  SELECT doc_id, {bits} AS f FROM shingled JOIN hashed USING (s) GROUP BY doc_id
), prints AS MATERIALIZED (
  SELECT d.doc_id, coalesce(f, 0::UBIGINT) AS f FROM d LEFT JOIN told ON d.doc_id = told.doc_id
), points AS MATERIALIZED (
  SELECT f, min(doc_id) AS least FROM prints GROUP BY f
), links AS MATERIALIZED (
  SELECT a.f AS x, b.f AS y FROM points a JOIN points b ON a.f <> b.f AND bit_count(xor(a.f, b.f)) <= {max_bits}
), reach AS (
  SELECT f AS x, f AS y FROM points UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), components AS (
  SELECT reach.x AS f, min(least) AS component_id FROM reach JOIN points ON points.f = reach.y GROUP BY reach.x
)
SELECT doc_id, printf('%016x', f) AS fingerprint, component_id FROM prints JOIN components USING (f)
"""


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds that compare every part with every entry, a round a pair of common table expressions; bounds play no part."""
    steps = [f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), cut AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, r AS k, x AS e FROM cut WHERE r < {entries}
)"""]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min({entries} * list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + k) AS best
  FROM cut JOIN book{n} USING (p) GROUP BY r, p
)""")
        if n < rounds:
            steps.append(f"""mean{n} AS (
  SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS e FROM (
    SELECT p, best % {entries} AS k, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS j FROM near{n}) GROUP BY ALL)
  GROUP BY p, k
), book{n + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(mean{n}.e, book{n}.e) AS e FROM book{n} LEFT JOIN mean{n} USING (p, k)
)""")
    steps.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest""")
    return "WITH " + ", ".join(steps[:-1]) + ", " + steps[-1]


ORACLES = {
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS body FROM documents
), g AS (
  SELECT doc_id, body, length(t) AS points, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM g
""",
    "op7_line_dedup": r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM (SELECT DISTINCT doc_id, l FROM d) WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, rank() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, p) AS k
    FROM w WHERE trim(a, ' ') <> '' OR trim(b, ' ') <> '' OR trim(c, ' ') <> '')
  WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS q FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM later) GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN gone.q IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone.q, i)), lambda i: l[i]), chr(10)), '') END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines_in, CAST(coalesce(len(gone.q), 0) AS BIGINT) AS n_lines_removed
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
""",
    "op9_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hits AS (
  SELECT dw.rid, dw.p, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g
), words AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""",
    "op11_vector_codes": _vector_codes_sql(),
    # CRC-32 by its polynomial, bit by bit: a byte is added, then eight times a bit is shifted out (-1).
    "op12_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda l: CASE WHEN ord(l) < 128 THEN [CAST(ord(l) AS BIGINT)] ELSE [195, CAST(ord(l) AS BIGINT) - 64] END)), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS h
  FROM runs
), counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM hashed GROUP BY 1
), words AS MATERIALIZED (
  SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5
), less AS MATERIALIZED (
  SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word AS word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word
), ranked AS (
  SELECT pairs.word, other, o.n AS other_n, count(*) OVER (PARTITION BY pairs.word) AS n_near, row_number() OVER (PARTITION BY pairs.word ORDER BY o.n DESC, other) AS k
  FROM pairs JOIN words o ON o.word = other
), forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND k = 1
), roots AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT forms.word, roots.root FROM roots JOIN forms ON forms.form = roots.word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
""",
    "op1_simhash": _simhash_sql(),
}
