"""HDF5 files: layouts, filters, look-up orders, pruned slices, and files written cell by cell."""

import warnings

import numpy as np
import pytest

import h5files
from fieldweave import Field, evaluate
from fieldweave.sources import hdf5
from fieldweave.sources.hdf5 import Hdf5Error, Hdf5File, Scan, describe, find, open_hdf5, save_hdf5, stretch_shape
from grids import to_array, to_field

RNG = np.random.default_rng(12)


def values(field):
    return to_array(evaluate("f", {"f": field}))


def plain(array, chunk=None, filters=(), attributes=None, skip=(), fill=None):
    return array, chunk, filters, attributes or {}, skip, fill


CASES = {
    "contiguous": ("<f8", None, ()), "chunked": ("<f8", (3, 4, 2), ()), "deflate": ("<f8", (3, 4, 2), (1,)), "shuffled": ("<f4", (4, 3, 5), (2, 1)),
    "summed": ("<f8", (2, 2, 2), (2, 1, 3)), "big_endian": (">f8", (3, 4, 2), (2, 1)), "integers": (">i2", (3, 4, 2), ()), "unsigned": ("<u1", None, ()),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("userblock", [0, 1024])
def test_old_layouts(spark, tmp_path, case, userblock):
    dtype, chunk, filters = CASES[case]
    a = (RNG.normal(size=(8, 7, 5)) * 50).astype(dtype) if np.dtype(dtype).kind == "f" else RNG.integers(0, 100, (8, 7, 5)).astype(dtype)
    path = h5files.old_file(tmp_path / "a.h5", {"field": plain(a, chunk, filters), "spacing": plain(np.array([0.5, 0.25, 2.0])), "origin": plain(np.array([1.0, 2.0, 3.0]))}, userblock=userblock)
    f = open_hdf5(spark, path)
    assert f.shape == (8, 7, 5) and f.spacing == (0.5, 0.25, 2.0) and f.origin == (1.0, 2.0, 3.0)
    assert np.array_equal(values(f), a.astype(float))
    part = f.slice((2, 7), None, (1, 4))
    assert np.array_equal(values(part), a[2:7, :, 1:4].astype(float)) and part.origin == (2.0, 2.0, 5.0)


@pytest.mark.parametrize("index,chunk,filters,bits", [("single", (6, 9), (), 10), ("single", (6, 9), (1,), 10), ("implicit", (4, 4), (), 10), ("fixed", (2, 4), (), 10), ("fixed", (2, 4), (2, 1), 10), ("fixed", (2, 4), (1,), 2)])
def test_new_layouts(spark, tmp_path, index, chunk, filters, bits):
    a = RNG.normal(size=(6, 9))
    f = open_hdf5(spark, h5files.new_file(tmp_path / "a.h5", "data", a, chunk, index, filters, bits))
    assert f.spacing == (0.25, 0.25) and np.array_equal(values(f), a)
    assert np.array_equal(values(f.slice(None, (5, 8))), a[:, 5:8])


def test_chunks_never_written_hold_the_fill_value(spark, tmp_path):
    a = RNG.normal(size=(6, 6))
    want = a.copy()
    want[2:4, 4:6] = -7.0
    path = h5files.old_file(tmp_path / "a.h5", {"field": plain(a, (2, 2), (1,), skip={(1, 2)}, fill=-7.0)})
    with pytest.warns(UserWarning, match="spacing"):
        assert np.array_equal(values(open_hdf5(spark, path)), want)
    empty = h5files.old_file(tmp_path / "b.h5", {"field": plain(a, (6, 6), skip={(0, 0)})})
    assert not values(open_hdf5(spark, empty, spacing=1.0)).any()
    holes = h5files.new_file(tmp_path / "c.h5", "data", a, (2, 2), "fixed", skip={(1, 2)})
    want[2:4, 4:6] = 0.0
    assert np.array_equal(values(open_hdf5(spark, holes)), want)


def test_what_is_taken_for_the_data_and_the_grid(tmp_path):
    a, one = np.arange(12.0).reshape(3, 4) + np.zeros((3, 4)), np.arange(20.0)
    file = lambda name, arrays, **kw: h5files.old_file(tmp_path / name, arrays, **kw)
    assert describe(file("a", {"data": plain(a), "field": plain(one)}))["dataset"] == "field"
    assert describe(file("b", {"zeta": plain(a), "data": plain(one)}))["dataset"] == "data"
    first = describe(file("c", {"zeta": plain(a), "beta": plain(one, attributes={"voxel_size": 0.5})}))
    assert first["dataset"] == "beta" and not first["usual"] and first["spacing"] == [0.5] and first["origin"] is None
    assert describe(file("c2", {"zeta": plain(a), "beta": plain(one)}), "zeta")["dataset"] == "zeta"
    # A dataset is taken before attributes of the file, and those before the data's; `spacing` before other hints.
    own = {"field": plain(a, attributes={"spacing": [3.0, 4.0], "dx": 5.0, "origin": [1.0, 1.0]})}
    assert describe(file("d", own))["spacing"] == [3.0, 4.0] and describe(file("e", own, root_attributes=[("spacing", [1.0, 2.0])]))["spacing"] == [1.0, 2.0]
    assert describe(file("f", {**own, "spacing": plain(np.array([7.0, 8.0]))}))["spacing"] == [7.0, 8.0]
    assert describe(file("g", own, root_attributes=[("origin", [9.0, 9.0])]))["origin"] == [9.0, 9.0]
    with pytest.raises(KeyError):
        describe(file("h", own), "nothing")
    (tmp_path / "i").write_bytes(b"no such file" * 100)
    with pytest.raises(Hdf5Error):
        describe(str(tmp_path / "i"))


def test_warnings_and_arguments(spark, tmp_path):
    path = h5files.old_file(tmp_path / "a.h5", {"zeta": plain(RNG.normal(size=(3, 4)))})
    with pytest.warns(UserWarning, match="zeta"):
        f = open_hdf5(spark, path, spacing=(0.5, 0.1), origin=(1, 2))
    assert f.spacing == (0.5, 0.1) and f.origin == (1.0, 2.0)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert open_hdf5(spark, path, dataset="zeta", spacing=2.0).spacing == (2.0, 2.0)


def read_cells(df):
    """Rows that the scan gave out, by the plan's own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_slices_leave_out_chunks_on_any_axis(spark, tmp_path):
    a = RNG.normal(size=(16, 16, 16))
    f = open_hdf5(spark, h5files.old_file(tmp_path / "a.h5", {"field": plain(a, (4, 4, 4))}), spacing=1.0)
    for axis in range(3):
        part = f.slice(*[(5, 8) if d == axis else None for d in range(3)])
        assert read_cells(part.df) == 3 * 256
        assert np.array_equal(values(part), np.take(a, range(5, 8), axis))
    scan = Scan(find(Hdf5File(str(tmp_path / "a.h5")), None)[1], [5, 0, 13], [8, 3, None])
    assert scan.chunks == 1 and scan.first == [1, 0, 3]
    nothing = f.df.where("i0 >= 20")
    assert nothing.count() == 0 and f.df.where("i0 = 3 and v > 0").count() == (a[3] > 0).sum()


def test_partitions_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hdf5, "STRETCH_BYTES", 200)
    a = RNG.normal(size=(9, 5, 8))
    assert stretch_shape((9, 5, 8), 8) == (1, 3, 8) and stretch_shape((9, 50), 8) == (1, 25) and stretch_shape((2, 3, 4), 8) == (2, 3, 4)
    scan = Scan(find(Hdf5File(h5files.old_file(tmp_path / "a.h5", {"field": plain(a)})), None)[1], [0] * 3, [None] * 3)
    assert scan.chunks == 18
    file, got = Hdf5File(str(tmp_path / "a.h5")), np.full(a.shape, np.nan)
    for k in range(scan.chunks):
        for batch in scan.batches(file, k):
            i, j, l, v = (c.to_numpy() for c in batch.columns)
            got[i, j, l] = v
    assert np.array_equal(got, a)


@pytest.mark.parametrize("shape", [(7,), (5, 6), (4, 3, 5), (3, 2, 2, 3)])
def test_written_files(spark, tmp_path, shape):
    a = RNG.normal(size=shape)
    path = save_hdf5(to_field(spark, a, spacing=tuple(0.5 + d for d in range(len(shape))), origin=(1.0,) * len(shape)), str(tmp_path / "deep" / "a.h5"))
    f = open_hdf5(spark, path)
    assert f.shape == shape and f.spacing == tuple(0.5 + d for d in range(len(shape))) and f.origin == (1.0,) * len(shape)
    assert np.array_equal(values(f), a)
    save_hdf5(f.__class__(f.df.selectExpr(*[c for c in f.df.columns if c != "v"], "v * 2 AS v"), shape), path + "2")
    assert np.array_equal(values(open_hdf5(spark, path + "2")), 2 * a)
    assert sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["a.h5", "a.h52"]


def test_a_file_lacks_no_cell(spark, tmp_path):
    f = to_field(spark, RNG.normal(size=(4, 3)))
    holes = Field(f.df.where("i0 <> 2"), (4, 3))
    with pytest.raises(Exception, match="9 cells were written"):
        save_hdf5(holes, str(tmp_path / "a.h5"))
    with pytest.raises(Exception):
        save_hdf5(Field(f.df, (3, 3)), str(tmp_path / "a.h5"))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError):
        save_hdf5(Field(f.df, (4, 3)), "s3://bucket/a.h5")


def test_expressions_over_a_file(spark, tmp_path):
    a = RNG.normal(size=(6, 5, 4))
    path = h5files.old_file(tmp_path / "a.h5", {"field": plain(a, (3, 2, 4), (2, 1))})
    got = to_array(evaluate("laplacian(f) + f**2", {"f": open_hdf5(spark, path, spacing=1.0)}, boundary="periodic"))
    want = sum(np.roll(a, s, d) for d in range(3) for s in (1, -1)) - 6 * a + a**2
    assert np.allclose(got, want, atol=1e-12)
