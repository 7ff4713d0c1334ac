"""The driver's contract, and a few registered queries against their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
SOME = ["laplacian_periodic", "gradient_neumann", "hessian", "reduce_entropy", "linalg_eigenvalues", "spectral_fft", "distance_transform", "integrate_simpson_even", "compile_mixed", "tiles_overlap", "store_roundtrip", "store_slice_eager", "run_stream_execute", "run_stream_stats", "run_pipeline", "run_registered_operator", "spectral_fft_1d", "spectral_fft_forward", "distance_transform_1d"]


def test_entry(spark):
    assert entry.entry(spark).count() == 50 * 11 * 9


def test_names():
    from fieldweave.queries import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)
    a = sorted(map(tuple, got[key].astype(float).round(6).values.tolist()))
    b = sorted(map(tuple, want[key].astype(float).round(6).values.tolist()))
    assert len(a) == len(b) and all(x != x and y != y or abs(x - y) < 2e-6 for r, s in zip(a, b) for x, y in zip(r, s))
