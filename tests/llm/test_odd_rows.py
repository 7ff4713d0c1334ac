"""Every operator and pipeline stage over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import CLASHING, ODD, SCHEMA
from fieldweave.llm.decontaminate import decontaminate
from fieldweave.llm.exact_dedup import exact_dedup
from fieldweave.llm.html_extract import extract_main_text
from fieldweave.llm.language_id import identify_languages, train_language_model
from fieldweave.llm.line_dedup import line_dedup
from fieldweave.llm.packing import pack
from fieldweave.llm.queries import tokenizer_path
from fieldweave.llm.sharding import shard_by_bytes
from fieldweave.llm.simhash import simhash_components
from fieldweave.llm.similar import similar_components
from fieldweave.llm.substring_dedup import repeated_passages
from fieldweave.llm.toxicity import score_toxicity, train_toxicity


def odd(spark, rows=ODD, clashing=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("own").alias(c) for c in CLASHING]) if clashing else df


def benchmark(docs):
    return docs.sparkSession.createDataFrame([(1, "three four five"), (2, None), (3, ""), (3, "no id at all here")], "item_id long, text string").withColumn("words", F.lit(1))


def labels(docs):
    return docs.sparkSession.createDataFrame([(4, 1, 1), (6, 0, 0), (None, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))


OPERATORS = {
    "simhash": simhash_components,
    "similar": similar_components,
    "packing": lambda d: pack(d, tokenizer_path()),
    "exact_dedup": exact_dedup,
    "substring_dedup": repeated_passages,
    "sharding": shard_by_bytes,
    "toxicity": lambda d: score_toxicity(d, train_toxicity(d, labels(d))),
    "line_dedup": line_dedup,
    "language_id": lambda d: identify_languages(d, train_language_model(d)),
    "decontaminate": lambda d: decontaminate(d, benchmark(d)),
    "decontaminate_in_blocks": lambda d: decontaminate(d, benchmark(d), table_bytes=300),
    "decontaminate_carried": lambda d: decontaminate(d, benchmark(d), carry=True),
    "html": lambda d: extract_main_text(d.drop("url", "html").withColumnsRenamed({"doc_id": "page_id", "source": "url"}).withColumn("html", F.col("text")), sample_pages=40),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](odd(spark))
    assert len(out.columns) == len(set(out.columns))
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ODD}
    elif name == "substring_dedup":
        assert not {r.doc_id for r in rows} & {None, 1, 2, 3}
    else:
        assert sorted(str(r[out.columns[0]]) for r in rows) == sorted(str(r[0]) for r in ODD)
    again = OPERATORS[name](odd(spark).repartition(3)).collect()
    if name not in ("packing",):
        assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark, [])).collect() == []


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages(spark, tmp_path, rows):
    docs = odd(spark, rows)
    benchmark(docs).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r.score == "own" and r.n_words == "own" for r in out.collect())
            docs = out
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_defined_results(spark):
    docs = odd(spark)
    exact = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert exact[1].group_size == 4 and exact[1].keep_id == 3 and exact[3].kept and not exact[2].kept
    assert exact[5].keep_id == 4 and exact[5].group_size == 3
    near = {r.doc_id: r for r in simhash_components(docs).collect()}
    assert near[1].fingerprint == "0" * 16 and near[2].component_id == near[3].component_id == 1 and near[5].component_id == 4
    lines = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert lines[7].text == "a\nb\nc\nd" and lines[8].text == "x\n" and lines[1].text is None and lines[1].n_lines_in == 0 and lines[2].n_lines_in == 1
    told = {r.doc_id: r.lang_pred for r in identify_languages(docs, train_language_model(docs)).collect()}
    assert told[1] == told[2] == told[3] == "und" and told[9] != "und"


def test_decontaminate_carried_in_blocks(spark):
    """Rows with null or repeated ids each get the verdict of their own text, however large the benchmark."""
    docs = odd(spark, [*ODD, (None, "three four five", "en", "s", 15), (5, "nothing of it", "en", "s", 13)])
    whole, blocks = (sorted(map(str, decontaminate(docs, benchmark(docs), carry=True, table_bytes=n).collect())) for n in (64 << 20, 300))
    assert len(whole) == len(ODD) + 2 and whole == blocks
