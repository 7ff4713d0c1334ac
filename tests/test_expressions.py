"""The expression grammar, sharing of equal subtrees, and pointwise values at their edges."""

import math

import numpy as np
import pytest
from grids import to_array, to_field

import fieldweave
from fieldweave import evaluate
from fieldweave.functions.registry import REGISTRY
from fieldweave.plans.expression import ExpressionError, call, parse

NAMES = {"f", "g"}


def read(text):
    return parse(text, NAMES, REGISTRY)


def test_grammar():
    f = call("field", name="f")
    assert read("f + 1").op == "add" and read("-f") == call("neg", f)
    assert read("f**2") == call("ipow", f, n=2) and read("f**1") == f and read("f**0").op == "number"
    assert read("f**0.5") == call("sqrt", f) and read("f**-1").op == "div"
    assert read("f**2.5").op == "exp" and read("f**17").op == "exp"
    assert read("lap(f)") == read("laplace(f)") == read("laplacian(f)")
    assert read("integrate(moving_average(f, window=3), dx=0.1)").param("dx") == 0.1
    assert read("divergence(gradient(f))").op == "laplacian"
    assert read("pi * f").args[0].param("value") == math.pi


@pytest.mark.parametrize("bad", ["", "f +", "h + 1", "nothing(f)", "f[0]", "f.x", "f if f else f", "f ** f", "lambda: f", "__import__('os')", "f @ g", "sum(f, **{})", "sum(f, dim=f)", "divergence(gradient(f, dim=0))", "True"])
def test_rejected(bad):
    with pytest.raises(ExpressionError):
        read(bad)


def test_pointwise_edges(spark):
    a = np.array([-2.0, -0.0, 0.0, 1e-20, 0.5, 3.0, np.nan, np.inf])
    f = {"f": to_field(spark, a)}
    got = lambda e: to_array(evaluate(e, f))
    assert np.allclose(got("clamp(f)")[:6], np.clip(a[:6], 0, 1)) and np.isnan(got("clamp(f)")[6])
    assert np.isclose(got("div_op(1, f)")[2], 1e15) and got("div_op(1, f)")[0] == -0.5
    assert np.isclose(got("log(f)")[0], math.log(1e-15)) and got("sqrt(f)")[0] == 0
    assert got("exp(f * 1000)")[5] == np.inf and got("tanh(f)")[7] == 1
    assert np.allclose(got("f**3")[:6], a[:6] ** 3)


def test_numbers_combine_without_joins(spark):
    a = np.random.default_rng(2).normal(size=(5, 4))
    r = evaluate("(f - mean(f)) / sqrt(variance(f))", {"f": to_field(spark, a)})
    assert np.allclose(to_array(r), (a - a.mean()) / a.std(ddof=1), atol=1e-12)
    assert "Join" not in r.df._jdf.queryExecution().optimizedPlan().toString().replace("JoinHint", "")


def test_fields_of_one_frame_need_no_join(spark):
    from fieldweave import Field

    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "i0 int, v double, v0 double")
    f, w = Field(df, (2,)), Field(df, (2,), "vector", 1)
    r = evaluate("f * select_component(w)", {"f": f, "w": w})
    assert to_array(r).tolist() == [2.0, 12.0] and "Join" not in r.df._jdf.queryExecution().optimizedPlan().toString()


def test_extension_and_dispatch(spark):
    from fieldweave import Value, register_operator

    register_operator("double_it", lambda ws, node, v: Value(v.kind, tuple(2 * c for c in v.columns), v.size), replace=True)
    a = np.arange(6.0).reshape(2, 3)
    p = fieldweave.double_it("f + a", f=to_field(spark, a), a=1.0)
    assert np.allclose(to_array(p.run()), 2 * (a + 1))
    assert fieldweave.sum("f", f=to_field(spark, a)).value == 15
    with pytest.raises(AttributeError):
        fieldweave.no_such_operator
    with pytest.raises(ValueError):
        register_operator("sum", lambda *a: None)
    assert "laplacian" in fieldweave.capability_report()
    del REGISTRY["double_it"]


def test_errors(spark):
    f = to_field(spark, np.ones((2, 2)))
    with pytest.raises(ExpressionError):
        evaluate("f + g", {"f": f, "g": to_field(spark, np.ones((3, 2)))})
    with pytest.raises(ExpressionError):
        evaluate("f + sum(f, dim=0)", {"f": f})
    with pytest.raises(ExpressionError):
        evaluate("f + 1", {})
    with pytest.raises(TypeError):
        fieldweave.Pipeline("sum").f = [1, 2]
