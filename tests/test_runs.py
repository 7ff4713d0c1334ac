"""Sweeps, slabs, blocked storage, line kernels, SQL functions, measures and self-checks."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from grids import to_array, to_field

import fieldweave as fw
from fieldweave import evaluate
from fieldweave.checks import validate_fft_consistency, validate_operator_identities
from fieldweave.functions.registry import register_operator
from fieldweave.functions.sql import register_sql_function
from fieldweave.plans.expression import ExpressionError
from fieldweave.streaming import measured, run_in_slabs, run_to_store, slabs, sweep

RNG = np.random.default_rng(14)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# Sweeps


def test_sweeps_of_numbers_and_fields(spark):
    a, b = RNG.normal(size=(5, 4)), RNG.normal(size=(5, 4))
    f = {"f": to_field(spark, a), "g": to_field(spark, b)}
    steps = np.linspace(-1.0, 2.0, 7)
    got = {round(r.k, 9): r.v for r in sweep("sum(exp(f * k)) + k * 2", f, "k", -1.0, 2.0, 7).collect()}
    assert all(got[round(k, 9)] == pytest.approx(np.exp(a * k).sum() + 2 * k) for k in steps)
    got = {round(r.k, 9): r.v for r in sweep("variance(f * k - mean(g * k)) + norm_l2(f)", f, "k", -1.0, 2.0, 7).collect()}
    assert all(got[round(k, 9)] == pytest.approx((a * k).var(ddof=1) + np.linalg.norm(a)) for k in steps)
    rows = sweep("f * k - mean(f * k) * laplacian(g)", f, "k", -1.0, 2.0, 7, boundary="periodic").collect()
    lap = sum(np.roll(b, s, d) for d in range(2) for s in (1, -1)) - 4 * b
    assert len(rows) == 7 * 20 and all(r.v == pytest.approx(a[r.i0, r.i1] * r.k - (a * r.k).mean() * lap[r.i0, r.i1]) for r in rows)
    pairs = {round(r.k, 9): (r.lo, r.hi) for r in sweep("min_max(f * k)", f, "k", 0.0, 1.0, 3).collect()}
    assert pairs[0.5] == pytest.approx((a.min() / 2, a.max() / 2))
    assert sweep("f * 0 + k", f, "k", 3.0, 9.0, 1).first().k == 3.0


def test_a_thousand_steps_read_the_field_once(spark, tmp_path):
    a = RNG.normal(size=(40, 30))
    stored = fw.open_field(spark, fw.save_field(to_field(spark, a), str(tmp_path / "f")))
    many = sweep("sum(exp(laplacian(f) * k))", {"f": stored}, "k", 0.0, 0.1, 1000, boundary="periodic")
    assert plan_of(many).count("parquet") == 1
    got = {round(r.k, 9): r.v for r in many.collect()}
    lap = sum(np.roll(a, s, d) for d in range(2) for s in (1, -1)) - 4 * a
    assert len(got) == 1000 and got[0.1] == pytest.approx(np.exp(lap * 0.1).sum())


def test_stencils_of_the_number_have_a_plan_each(spark):
    a = RNG.normal(size=(5, 4))
    got = sweep("sum(laplacian(f * k + f**2))", {"f": to_field(spark, a)}, "k", 0.0, 1.0, 2, boundary="dirichlet").collect()
    p = lambda x: sum(np.pad(x, 1)[1 + s : 6 + s, 1:-1] + np.pad(x, 1)[1:-1, 1 + s : 5 + s] for s in (1, -1)) - 4 * x
    assert [r.v for r in got] == pytest.approx([p(a**2).sum(), p(a + a**2).sum()])
    with pytest.raises(ExpressionError):
        sweep("f", {"f": to_field(spark, a)}, "f", 0.0, 1.0, 2)
    with pytest.raises(ValueError):
        sweep("f", {"f": to_field(spark, a)}, "k", 0.0, 1.0, 0)


# Slabs


@pytest.mark.parametrize("axis,slab", [(0, 1), (0, 4), (1, 3), (0, 100)])
@pytest.mark.parametrize("boundary", ["periodic", "neumann"])
def test_slabs_equal_the_whole(spark, tmp_path, axis, slab, boundary):
    a, b = RNG.normal(size=(11, 9)), RNG.normal(size=(11, 9))
    paths = {k: fw.save_field(to_field(spark, x, origin=(1.0, 2.0)), str(tmp_path / k)) for k, x in {"f": a, "g": b}.items()}
    expression = "laplacian(moving_average(f, window=3, boundary=\"%s\")) * c + gradient(gradient(g, dim=0), dim=1)" % boundary
    got = run_in_slabs(spark, expression, paths, str(tmp_path / "out"), axis, slab, boundary=boundary, constants={"c": 2.0})
    whole = evaluate(expression, {k: fw.open_field(spark, p) for k, p in paths.items()}, boundary=boundary, constants={"c": 2.0})
    want, back = to_array(whole), fw.open_field(spark, str(tmp_path / "out"))
    assert np.allclose(to_array(evaluate("f", {"f": back})), want, atol=1e-12) and back.origin == (1.0, 2.0)
    assert got["n_chunks"] == -(-a.shape[axis] // slab) and got["mean"] == pytest.approx(want.mean()) and (got["min"], got["max"]) == pytest.approx((want.min(), want.max()))


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    a = RNG.normal(size=(12, 5))
    path, out = fw.save_field(to_field(spark, a), str(tmp_path / "f")), str(tmp_path / "out")
    real, calls = slabs.write_text, []

    def failing(where, text):
        calls.append(where)
        if len(calls) == 3:
            raise OSError("the machine is lost")
        real(where, text)

    monkeypatch.setattr(slabs, "write_text", failing)
    with pytest.raises(OSError):
        run_in_slabs(spark, "gradient(f)", {"f": path}, out, slab=2)
    monkeypatch.setattr(slabs, "write_text", real)
    kept = {name: os.stat(f"{out}/data/slab={k}/{name}").st_mtime_ns for k in (0, 1) for name in os.listdir(f"{out}/data/slab={k}") if name.endswith(".parquet")}
    got = run_in_slabs(spark, "gradient(f)", {"f": path}, out, slab=2)
    assert got["resumed"] == 2 and got["n_chunks"] == 6
    assert all(os.stat(f"{out}/data/slab={k}/{name}").st_mtime_ns == t for k in (0, 1) for name, t in kept.items() if os.path.exists(f"{out}/data/slab={k}/{name}"))
    want = np.stack([(np.roll(a, -1, d) - np.roll(a, 1, d)) / 2 for d in range(2)], -1)
    assert np.allclose(to_array(evaluate("f", {"f": fw.open_field(spark, out)})), want)
    # Another expression, or a wish for a fresh run, starts over.
    assert run_in_slabs(spark, "f + 1", {"f": path}, out, slab=2)["resumed"] == 0
    assert run_in_slabs(spark, "f + 1", {"f": path}, out, slab=2)["resumed"] == 6
    assert run_in_slabs(spark, "f + 1", {"f": path}, out, slab=2, resume=False)["resumed"] == 0


def test_slabs_read_their_rows_alone(spark, tmp_path):
    a = RNG.normal(size=(400, 50))
    path = fw.save_field(to_field(spark, a), str(tmp_path / "f"), partitions=8)
    with measured(spark) as seen:
        run_in_slabs(spark, "laplacian(f)", {"f": path}, str(tmp_path / "out"), slab=100)
    # Four slabs with their neighbours; files of which no cell is wanted are not read.
    assert seen.rows_in < 2.5 * a.size


def test_what_slabs_do_not_take(spark, tmp_path):
    path = fw.save_field(to_field(spark, RNG.normal(size=(6, 5))), str(tmp_path / "f"))
    for bad in ("fft(f)", "f - mean(f)", 'laplacian(f, boundary="periodic") + laplacian(f, boundary="neumann")'):
        with pytest.raises(ExpressionError):
            run_in_slabs(spark, bad, {"f": path}, str(tmp_path / "out"))
    with pytest.raises(ExpressionError):
        run_in_slabs(spark, "f", {"f": path}, str(tmp_path / "out"), axis=2)


# Storage by blocks


def test_blocks_prune_on_every_axis(spark, tmp_path):
    a = np.arange(24 * 24 * 24, dtype=float).reshape(24, 24, 24)
    field = to_field(spark, a, spacing=(0.5, 1.0, 2.0))
    path = fw.save_field(field, str(tmp_path / "f"), partitions=3, blocks=(6, 6, 6))
    back = fw.open_field(spark, path)
    assert back.spacing == (0.5, 1.0, 2.0) and np.array_equal(to_array(evaluate("f", {"f": back})), a)
    assert np.array_equal(to_array(evaluate("f", {"f": back.slice(None, (3, 9), (20, 24))})), a[:, 3:9, 20:])

    def groups_met(axis, low, high):
        met = 0
        for name in os.listdir(f"{path}/data"):
            if name.endswith(".parquet"):
                meta = pq.ParquetFile(f"{path}/data/{name}").metadata
                for k in range(meta.num_row_groups):
                    stats = meta.row_group(k).column(axis).statistics
                    met += stats.max >= low and stats.min < high
        return met

    met = [groups_met(axis, 7, 9) for axis in range(3)]
    assert max(met) <= 2 * min(met) and max(met) <= 32
    plain = fw.save_field(field, str(tmp_path / "g"))
    assert np.array_equal(to_array(evaluate("f", {"f": fw.open_field(spark, plain)})), a)
    for bad in ((1, 2), (0, 1, 1)):
        with pytest.raises(ValueError):
            fw.save_field(field, str(tmp_path / "h"), blocks=bad)


def test_order_of_blocks(spark):
    from fieldweave.sources.store import morton
    from pyspark.sql import functions as F

    rows = spark.range(64).select((F.col("id") / 8).cast("int").alias("x"), (F.col("id") % 8).cast("int").alias("y"))
    for r in rows.withColumn("z", morton([F.col("x"), F.col("y")], 3)).collect():
        assert r.z == sum(((r.x >> b & 1) << (2 * b + 1)) | ((r.y >> b & 1) << (2 * b)) for b in range(3))


# Kernels of lines


def kernel():
    """A function that workers get by value, as this module is not theirs."""

    def running(values, factor=1.0):
        """running sums"""
        return np.cumsum(values, axis=1) * factor

    return running


def test_line_kernels(spark):
    register_operator("running", line=kernel(), replace=True)
    a = RNG.normal(size=(5, 4, 3))
    f = {"f": to_field(spark, a)}
    assert np.allclose(to_array(evaluate("running(f, dim=1, factor=2.0) + f", f)), 2 * np.cumsum(a, axis=1) + a)
    assert np.allclose(to_array(evaluate("running(f)", f)), np.cumsum(a, axis=0)) and "running sums" in fw.functions.registry.REGISTRY["running"].doc
    register_operator("shorter", line=lambda x: x[:, 1:], replace=True)
    with pytest.raises(Exception, match="a function of lines gave"):
        evaluate("shorter(f)", f).df.collect()
    from fieldweave.operators.lines import bounded_lines

    with bounded_lines(4), pytest.raises(ExpressionError, match="whole lines"):
        evaluate("running(f)", f)
    with pytest.raises(ValueError):
        register_operator("both", line=kernel(), lower=lambda n, d: n)


def test_line_kernels_in_sql(spark):
    register_operator("running", line=kernel(), replace=True)
    register_sql_function(spark, "running", factor=3.0)
    a = RNG.normal(size=(5, 4))
    to_field(spark, a).df.repartition(3).createOrReplaceTempView("cells")
    for dim in (0, 1):
        got = np.zeros((5, 4))
        for r in spark.sql(f"SELECT * FROM running(TABLE(cells), {dim})").collect():
            got[r.i0, r.i1] = r.v
        assert np.allclose(got, 3 * np.cumsum(a, axis=dim))
    with pytest.raises(ValueError):
        register_sql_function(spark, "laplacian")


# Measures and self-checks


def test_runs_tell_what_they_read_and_wrote(spark, tmp_path):
    a = RNG.normal(size=(200, 100))
    path = fw.save_field(to_field(spark, a), str(tmp_path / "f"))
    got = run_to_store(spark, "f * 2 + 1", {"f": path}, str(tmp_path / "out"))
    size = sum(os.path.getsize(f"{tmp_path}/out/data/{n}") for n in os.listdir(f"{tmp_path}/out/data") if n.endswith(".parquet"))
    seen = got["measures"]
    assert seen.rows_in == 20_000 * (seen.rows_in // 20_000) and seen.rows_in >= 20_000 and seen.rows_out >= 20_000
    assert got["bytes_out"] >= size and got["bytes_in"] >= 20_000 and got["cells_per_s"] == pytest.approx(20_000 / seen.elapsed_s) and "MB" in str(seen)
    with measured(spark) as nothing:
        pass
    assert nothing.stages == nothing.rows_in == 0


def test_self_checks(spark):
    assert set(validate_fft_consistency(spark)) == {"backward", "ortho", "forward"}
    assert max(validate_operator_identities(spark).values()) < 1e-9
    with pytest.raises(AssertionError):
        validate_fft_consistency(spark, (8, 8), tolerance=0.0)
