"""Storing, ingesting, tiling and running from store to store."""

import numpy as np
import pytest
from grids import to_array, to_field
from pyspark.sql import functions as F

import fieldweave as fw
from fieldweave.plans.evaluate import Result

A = np.random.default_rng(4).normal(size=(6, 5))


def as_result(field):
    return Result(field.df, field.shape, field.kind, field.size)


def test_round_trip(spark, tmp_path):
    f = to_field(spark, A, spacing=(0.5, 2.0), origin=(1.0, -1.0))
    fw.save_field(f, str(tmp_path / "f"), partitions=3)
    back = fw.open_field(spark, str(tmp_path / "f"))
    assert (back.shape, back.spacing, back.origin) == (f.shape, f.spacing, f.origin) and np.array_equal(to_array(as_result(back)), A)
    plan = back.slice((2, 4)).df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(i0,2)" in plan
    assert np.array_equal(to_array(as_result(back.slice((2, 4), (1, 5)))), A[2:4, 1:5]) and back.slice((2, 4)).origin == (2.0, -1.0)


def test_load_modes(spark, tmp_path):
    path = fw.save_field(to_field(spark, A), str(tmp_path / "f"))
    assert not fw.load_field(spark, path).df.is_cached and fw.load_field(spark, path, "auto").df.is_cached
    with pytest.raises(MemoryError):
        fw.load_field(spark, path, "eager", max_eager_gb=1e-12)
    with pytest.raises(ValueError):
        fw.load_field(spark, path, "sometimes")


def test_ingest(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 0.5), (0, 0, 2.0, 0.5), (2, 1, 5.0, 0.5)], "i0 int, i1 int, temperature double, dx double")
    with pytest.warns(UserWarning, match="temperature"):
        f = fw.ingest(spark, df)
    assert f.shape == (3, 2) and f.spacing == (0.5, 0.5)
    assert np.array_equal(to_array(as_result(f)), [[3, 0], [0, 0], [0, 5]])
    with pytest.raises(KeyError):
        fw.ingest(spark, df, value_column="pressure")
    with pytest.raises(KeyError):
        fw.ingest(spark, df, coordinate_columns=("x",))


def test_stream_execute_and_pipeline(spark, tmp_path):
    path = fw.save_field(to_field(spark, A), str(tmp_path / "f"))
    out = fw.stream_execute(spark, "laplacian", path, str(tmp_path / "g"), dx=0.5)
    want = sum(np.roll(A, 1, d) + np.roll(A, -1, d) - 2 * A for d in (0, 1)) / 0.25
    assert out["shape_out"] == A.shape and np.isclose(out["min"], want.min()) and np.isclose(out["max"], want.max()) and abs(out["mean"]) < 1e-9
    assert np.allclose(to_array(as_result(fw.open_field(spark, str(tmp_path / "g")))), want)
    with pytest.raises(ValueError):
        fw.stream_execute(spark, "no_such", path, str(tmp_path / "h"))
    p = fw.Pipeline("laplacian", "f").set(dx=0.5, output=str(tmp_path / "p"))
    p.f = path
    assert np.allclose(to_array(p.run()), want) and p.run() is p.run()
    assert np.allclose(to_array(as_result(p[(1, 3)])), want[1:3])
    assert np.allclose(to_array(as_result(fw.open_field(spark, str(tmp_path / "p")))), want)


def test_tiles_and_parts(spark):
    f = to_field(spark, A)
    cut = fw.tiles(f, (4, 3), overlap=1).toPandas()
    assert len(cut[~cut.ghost]) == A.size
    own = cut[cut.tile == 0]
    assert set(zip(own.i0, own.i1)) == {(i, j) for i in range(5) for j in range(4)}
    parts = fw.decompose_field(f, parts=3, dim=0, overlap=1).groupBy("part").agg(F.min("i0"), F.max("i0")).orderBy("part").collect()
    assert [tuple(r) for r in parts] == [(0, 0, 2), (1, 1, 4), (2, 3, 5)]


def test_sweep_and_presets(spark):
    rows = fw.sweep("sum(f * a)", {"f": to_field(spark, A)}, "a", 0.0, 2.0, 3).collect()
    assert np.allclose(sorted((r.a, r.v) for r in rows), [(a, a * A.sum()) for a in (0.0, 1.0, 2.0)])
    assert fw.preset("cluster")["spark.sql.adaptive.enabled"] == "true"


def test_hdf5_by_the_ending_of_a_path(spark, tmp_path):
    """Pipelines and runs read and write HDF5 files where a path ends like one, and reports tell rates."""
    path = fw.save_field(to_field(spark, A, spacing=(0.5, 2.0)), str(tmp_path / "f.h5"))
    assert (tmp_path / "f.h5").is_file() and fw.open_field(spark, path).spacing == (0.5, 2.0)
    assert fw.load_field(spark, path, "auto").df.is_cached
    p = fw.Pipeline(expression="f * k").set(output=str(tmp_path / "out.h5"))
    p.f, p.k = path, 3.0
    assert np.array_equal(to_array(p.run()), 3 * A) and "cells/s" in p.report() and p.measures.stages >= 1
    assert np.array_equal(to_array(as_result(fw.open_field(spark, str(tmp_path / "out.h5")))), 3 * A)
    got = fw.run_to_store(spark, "f + 1", {"f": path}, str(tmp_path / "more.h5"))
    assert got["n_chunks"] == 1 and got["max"] == A.max() + 1
