"""Graphs with several sinks: one exchange, seeds, stored results."""

import numpy as np
import pytest

from fieldweave.plans.expression import ExpressionError
from fieldweave.plans.graph import Graph, open_results
from grids import to_array, to_field

RNG = np.random.default_rng(8)


def three(field):
    g = Graph()
    f = g.constant(field, "f")
    g.add("laplacian", [f], node_id="lap")
    grad = g.add("grad", [f], {"boundary": "periodic"}, "grad")
    g.add("norm_last", [grad], node_id="speed")
    g.add("sum", ["lap"], node_id="total")
    return g


def arrays(a):
    lap = sum(np.roll(a, s, d) for d in range(2) for s in (1, -1)) - 4 * a
    grad = np.stack([(np.roll(a, -1, d) - np.roll(a, 1, d)) / 2 for d in range(2)], -1)
    return lap, grad, np.linalg.norm(grad, axis=-1)


def test_results_share_a_frame(spark):
    a = RNG.normal(size=(6, 5))
    g = three(to_field(spark, a))
    assert g.sinks() == ["speed", "total"] and len(g) == 5 and g.consumers()["f"] == ["lap", "grad"]
    got = g.run(["lap", "grad", "speed", "total"], boundary="periodic")
    lap, grad, speed = arrays(a)
    assert np.allclose(to_array(got["lap"]), lap) and np.allclose(to_array(got["grad"]), grad) and np.allclose(to_array(got["speed"]), speed)
    assert got["total"].value == pytest.approx(lap.sum(), abs=1e-9) and got.numbers().columns == ["total"]
    frame = got.frame()
    assert frame.columns == ["i0", "i1", "lap", "grad_v0", "grad_v1", "speed"] and frame.count() == 30


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_several_results_cost_one_exchange(spark):
    g = three(to_field(spark, RNG.normal(size=(6, 5))))
    alone = exchanges(g.run(["lap"], boundary="periodic").frame())
    assert alone == 1 and exchanges(g.run(["lap", "grad", "speed"], boundary="periodic").frame()) == 1


def test_seeds_stand_for_nodes(spark):
    a, b = RNG.normal(size=(6, 5)), RNG.normal(size=(6, 5, 2))
    g = three(to_field(spark, a))
    got = g.run(["speed", "lap"], seed={"grad": to_field(spark, b, "vector", 2)}, boundary="periodic")
    assert np.allclose(to_array(got["speed"]), np.linalg.norm(b, axis=-1)) and np.allclose(to_array(got["lap"]), arrays(a)[0])
    # An earlier result serves as well, and nothing below it is evaluated.
    first = g.run(["grad"], boundary="periodic")
    again = g.run(["speed"], seed={"grad": first["grad"]})
    assert np.allclose(to_array(again["speed"]), arrays(a)[2])
    assert np.allclose(to_array(g.run(["speed"], seed={"speed": to_field(spark, a)})["speed"]), a)
    other = g.clone_with_replacement("grad", to_field(spark, b, "vector", 2))
    assert np.allclose(to_array(other.run(["speed"])["speed"]), np.linalg.norm(b, axis=-1)) and g.nodes["grad"].op == "gradient"
    scaled = Graph()
    scaled.constant(2.0, "k")
    scaled.constant(to_field(spark, a), "f")
    scaled.add("mul", ["k", "f"], node_id="twice")
    assert np.allclose(to_array(scaled.run()["twice"]), 2 * a) and np.allclose(to_array(scaled.run(seed={"k": 5})["twice"]), 5 * a)
    total = g.run(["total"], boundary="periodic")["total"]
    assert np.allclose(to_array(scaled.run(seed={"k": total})["twice"]), total.value * a)


def test_stored_results(spark, tmp_path):
    a = RNG.normal(size=(6, 5))
    kept = three(to_field(spark, a, spacing=(0.5, 1.0))).run(["lap", "grad"], boundary="periodic").save(str(tmp_path / "r"))
    assert np.allclose(to_array(kept["grad"]) if hasattr(kept["grad"], "value") else as_array(kept["grad"]), arrays(a)[1]) and kept["lap"].spacing == (0.5, 1.0)
    again = open_results(spark, str(tmp_path / "r"))
    assert np.allclose(as_array(again["lap"]), arrays(a)[0])
    plan = again["lap"].df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<i0:int,i1:int,lap:double>" in plan


def as_array(field):
    from fieldweave import evaluate

    return to_array(evaluate("f", {"f": field}))


def test_expressions_become_nodes(spark):
    a = RNG.normal(size=(6, 5))
    g = Graph()
    g.constant(to_field(spark, a), "f")
    g.add_expression("laplacian(f) + f*2", "x", boundary="periodic")
    g.add_expression("sum(x)", "s")
    got = g.run(["x", "s"])
    assert np.allclose(to_array(got["x"]), arrays(a)[0] + 2 * a) and got["s"].value == pytest.approx((arrays(a)[0] + 2 * a).sum(), abs=1e-9)


def test_errors(spark):
    g = Graph()
    g.constant(1.0, "one")
    with pytest.raises(ExpressionError):
        g.constant(2.0, "one")
    with pytest.raises(ExpressionError):
        g.add("no_such", ["one"])
    with pytest.raises(TypeError):
        g.constant("text")
    g.add("add", ["one", "later"], node_id="a")
    with pytest.raises(ExpressionError, match="unknown node 'later'"):
        g.sinks()
    g.add("neg", ["a"], node_id="later")
    with pytest.raises(ExpressionError, match="cycle"):
        g.order()
    with pytest.raises(ExpressionError):
        g.run(["nowhere"])
