"""Registered queries of the field engine and an independent SQL formulation of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.registry import register_operator
from fieldweave.functions.sql import register_sql_function
from fieldweave.operators.lines import bounded_lines
from fieldweave.plans.evaluate import Result, evaluate
from fieldweave.plans.graph import Graph
from fieldweave.sources import decompose_field, ingest, tiles
from fieldweave.sources import fixtures as fx
from fieldweave.sources.hdf5 import open_hdf5, save_hdf5
from fieldweave.sources.store import load_field, open_field, save_field
from fieldweave.sources.work import work_path
from fieldweave.streaming import run_in_slabs, run_to_store, stream_execute, sweep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Digits compared.
DIGITS = 6
#: Added before rounding: values are often exact multiples of 1e-8 or its halves, and would else lie on a tie between two roundings.
NUDGE = 3.3e-8

# SQL of the fixtures -------------------------------------------------------------------------------------

_G3 = """raw AS (
  SELECT CAST(l_quantity AS INT) - 1 AS i0, CAST(round(l_discount * 100) AS INT) AS i1, CAST(round(l_tax * 100) AS INT) AS i2,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS v, CAST(count(*) AS DOUBLE) AS n
  FROM lineitem GROUP BY 1, 2, 3
), f AS (
  SELECT CAST(a.x AS INT) AS i0, CAST(b.x AS INT) AS i1, CAST(c.x AS INT) AS i2, coalesce(v, 0.0) AS v, coalesce(n, 0.0) AS n,
         coalesce(v, 0.0) AS v0, coalesce(n, 0.0) / 10 AS v1, a.x * coalesce(n, 0.0) / 100 AS v2,
         CASE WHEN n > 0 AND CAST(n AS BIGINT) % 5 = 0 THEN 1.0 ELSE 0.0 END AS mask
  FROM range(50) a(x) CROSS JOIN range(11) b(x) CROSS JOIN range(9) c(x) LEFT JOIN raw ON raw.i0 = a.x AND raw.i1 = b.x AND raw.i2 = c.x
)"""
_P2 = """raw AS (
  SELECT p_size - 1 AS i0, CAST(replace(p_brand, 'Brand#', '') AS INT) - 1 AS i1, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / 1e5 AS v
  FROM part GROUP BY 1, 2
), f AS (
  SELECT CAST(a.x AS INT) AS i0, CAST(b.x AS INT) AS i1, coalesce(v, 0.0) AS v
  FROM range(50) a(x) CROSS JOIN range(25) b(x) LEFT JOIN raw ON raw.i0 = a.x AND raw.i1 = b.x
)"""
_S1 = """raw AS (
  SELECT date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS i0, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS v
  FROM lineitem GROUP BY 1
), f AS (SELECT CAST(a.x AS INT) AS i0, coalesce(v, 0.0) AS v FROM range(2499) a(x) LEFT JOIN raw ON raw.i0 = a.x)"""
_S2 = """raw AS (
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + extract(hour FROM ts) AS i0, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 1e4 AS v
  FROM events GROUP BY 1
), f AS (SELECT CAST(a.x AS INT) AS i0, coalesce(v, 0.0) AS v FROM range(720) a(x) LEFT JOIN raw ON raw.i0 = a.x)"""


def _m3(cell: Callable[[int, int], str]) -> str:
    return "f AS (SELECT CAST(vec_id AS INT) AS i0, " + ", ".join(f"{cell(r, c)} AS m{r}{c}" for r in range(3) for c in range(3)) + " FROM embeddings)"


_at = lambda r, c: f"CAST(embedding[{3 * r + c + 1}] AS DOUBLE)"
_M3 = _m3(_at)
_M3S = _m3(lambda r, c: f"({_at(r, c)} + {_at(c, r)}) / 2")
_M3I = _m3(lambda r, c: f"{_at(r, c)} + {2.0 if r == c else 0.0}")

_SHAPES = {_G3: fx.G3_SHAPE, _P2: fx.P2_SHAPE, _S1: fx.S1_SHAPE, _S2: fx.S2_SHAPE, _M3: (0,), _M3S: (0,), _M3I: (0,)}


class Sql:
    """A SELECT over a grid table that looks neighbours up by self-joins on shifted coordinates."""

    def __init__(self, fixture: str, source: str = "f", with_: str = ""):
        self.fixture, self.source, self.with_, self.shape, self.joins = fixture, source, with_, _SHAPES[fixture], {}

    def at(self, axis: int, index: str, column: str) -> str:
        key = (axis, index)
        alias = self.joins.setdefault(key, f"t{len(self.joins)}")
        return f"{alias}.{column}"

    def tap(self, column: str, axis: int, offset: int, boundary: str) -> str:
        n, i = self.shape[axis], f"f.i{axis}"
        if not offset:
            return f"f.{column}"
        if boundary == "periodic":
            return self.at(axis, f"({i} + {offset + n * 4}) % {n}", column)
        if boundary == "neumann":
            return self.at(axis, f"least(greatest({i} + {offset}, 0), {n - 1})", column)
        if boundary == "reflect":
            j = f"abs({i} + {offset})"
            return self.at(axis, f"CASE WHEN {j} > {n - 1} THEN {2 * (n - 1)} - {j} ELSE {j} END", column)
        return f"coalesce({self.at(axis, f'{i} + {offset}', column)}, 0.0)"

    def d(self, column: str, axis: int, h: float = 1.0, boundary: str = "neumann") -> str:
        """First derivative: central and wrapping, or with second-order one-sided ends."""
        if boundary == "periodic":
            return f"(({self.tap(column, axis, 1, boundary)} - {self.tap(column, axis, -1, boundary)}) / {2 * h})"
        t = lambda o: self.at(axis, f"f.i{axis} + {o}", column) if o else f"f.{column}"
        n = self.shape[axis]
        return (
            f"CASE WHEN f.i{axis} = 0 THEN (-3 * {t(0)} + 4 * {t(1)} - {t(2)}) / {2 * h} "
            f"WHEN f.i{axis} = {n - 1} THEN (3 * {t(0)} - 4 * {t(-1)} + {t(-2)}) / {2 * h} ELSE ({t(1)} - {t(-1)}) / {2 * h} END"
        )

    def cte(self, columns: dict[str, str]) -> str:
        """The SELECT without rounding, for use as a table of a next step."""
        at = [f"f.i{d}" for d in range(len(self.shape))]
        joins = ""
        for (axis, index), alias in self.joins.items():
            on = [f"{alias}.i{d} = " + (index if d == axis else f"f.i{d}") for d in range(len(self.shape))]
            joins += f" LEFT JOIN {self.source} {alias} ON " + " AND ".join(on)
        return f"SELECT {', '.join(at)}, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {self.source} f{joins}"

    def select(self, columns: dict[str, str]) -> str:
        return f"WITH {self.fixture}{', ' + self.with_ if self.with_ else ''}, result AS ({self.cte(columns)}) SELECT {', '.join(f'i{d}' for d in range(len(self.shape)))}, {', '.join(rounded(c) for c in columns)} FROM result"


def rounded(column: str, digits: int = DIGITS) -> str:
    return f"round({NUDGE} + {column}, {digits}) + 0.0 AS {column}"


def tidy(result: Result, digits: int = DIGITS) -> DataFrame:
    """A result with its values rounded and without negative zeros."""
    return tidy_frame(result.df, digits)


def tidy_frame(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[c if c.startswith("i") and c[1:].isdigit() else (F.round(F.lit(NUDGE) + F.col(c), digits) + F.lit(0.0)).alias(c) for c in df.columns])


_FIXTURES = {_G3: fx.g3, _P2: fx.p2, _S1: fx.s1, _S2: fx.s2, _M3: fx.m3, _M3S: lambda s, d: fx.m3(s, d, "symmetric"), _M3I: lambda s, d: fx.m3(s, d, "shifted")}


def register(name: str, fixture: str, expression: str, sql: str | None, dx=1.0, boundary: str = "neumann", digits: int = DIGITS, constants=None) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(evaluate(expression, _FIXTURES[fixture](spark, sf_dir), dx, boundary, constants), digits)
    if sql is not None:
        ORACLES[name] = sql


def _one(fixture: str, **columns: str) -> str:
    """SQL of a number, or of several, over all cells."""
    return f"WITH {fixture}, result AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM f) SELECT {', '.join(rounded(c) for c in columns)} FROM result"


def _cells(fixture: str, **columns: str) -> str:
    return Sql(fixture).select(columns)


# Pointwise -----------------------------------------------------------------------------------------------

for _name, _expr, _sql in (
    ("add", "add(f, n)", "v + n"),
    ("sub", "f - n", "v - n"),
    ("mul", "f * n", "v * n"),
    ("mul_scalar", "mul(f, scalar=2.5)", "v * 2.5"),
    ("div_guarded", "div_op(n, f)", "n / CASE WHEN abs(v) < 1e-15 THEN CASE WHEN v < 0 THEN -1e-15 ELSE 1e-15 END ELSE v END"),
    ("neg", "-f", "-v"),
    ("clamp", "clamp(f, lo=0.05, hi=0.2)", "least(greatest(v, 0.05), 0.2)"),
    ("exp", "exp(f)", "exp(v)"),
    ("log", "log(f)", "ln(greatest(v, 1e-15))"),
    ("sqrt", "sqrt(f - 0.1)", "sqrt(greatest(v - 0.1, 0.0))"),
    ("sin", "sin(f * n)", "sin(v * n)"),
    ("cos", "cos(f * pi)", "cos(v * pi())"),
    ("euler", "E * f + E**2", "exp(1.0) * v + exp(2.0)"),
    ("tanh", "tanh(f)", "tanh(v)"),
    ("pow_int", "f**3", "v * v * v"),
    ("pow_neg", "(f + 1)**-2", "1 / ((v + 1) * (v + 1))"),
    ("pow_half", "n**0.5", "sqrt(n)"),
    ("pow_frac", "(f + 1)**1.5", "exp(1.5 * ln(greatest(v + 1, 1e-15)))"),
    ("bench_expr", "f**2 + tanh(f)*exp(f)", "v * v + tanh(v) * exp(v)"),
    ("quotient", "f / (n + 1)", "v / (n + 1)"),
):
    register(f"pointwise_{_name}", _G3, _expr, _cells(_G3, v=f"({_sql})"))

# Stencils ------------------------------------------------------------------------------------------------


def _laplacian(fixture: str, boundary: str, dx=None, column: str = "v") -> str:
    q = Sql(fixture)
    dx = dx or (1.0,) * len(q.shape)
    return q.select({"v": " + ".join(f"({q.tap(column, d, 1, boundary)} + {q.tap(column, d, -1, boundary)} - 2 * f.{column}) / {h * h}" for d, h in enumerate(dx))})


for _b in ("periodic", "neumann", "dirichlet", "reflect"):
    register(f"laplacian_{_b}", _G3, "laplacian(f)", _laplacian(_G3, _b), boundary=_b)
register("laplacian_spacing", _G3, "laplacian(f)", _laplacian(_G3, "periodic", (0.5, 1.0, 2.0)), dx=(0.5, 1.0, 2.0), boundary="periodic")
register("laplacian_1d", _S1, "laplacian(f)", _laplacian(_S1, "neumann"))
register("laplacian_2d", _P2, "laplacian(f)", _laplacian(_P2, "reflect"), boundary="reflect")

for _b in ("periodic", "neumann"):
    _q = Sql(_G3)
    register(f"gradient_{_b}", _G3, "gradient(f)", _q.select({f"v{d}": _q.d("v", d, 0.5, _b) for d in range(3)}), dx=0.5, boundary=_b)
    _q = Sql(_G3)
    register(f"divergence_{_b}", _G3, "divergence(w)", _q.select({"v": " + ".join(f"({_q.d(f'v{d}', d, 0.5, _b)})" for d in range(3))}), dx=0.5, boundary=_b)
_q = Sql(_G3)
register("gradient_dim", _G3, "gradient(f, dim=1)", _q.select({"v": _q.d("v", 1)}))
_q = Sql(_S2)
register("gradient_1d", _S2, "gradient(f)", _q.select({"v0": _q.d("v", 0)}))
_q = Sql(_G3)
_curl = {"v0": (2, 1, 1, 2), "v1": (0, 2, 2, 0), "v2": (1, 0, 0, 1)}
register("curl_3d", _G3, "curl(w)", _q.select({c: f"({_q.d(f'v{a}', x)}) - ({_q.d(f'v{b}', y)})" for c, (a, x, b, y) in _curl.items()}))
_q = Sql(_P2, "g", "g AS (SELECT i0, i1, v AS v0, i0 * v / 10 AS v1 FROM f)")
QUERIES["curl_2d"] = lambda spark, sf_dir: tidy(evaluate("curl(stack_components(f, f * x / 10))", _with_index(fx.p2(spark, sf_dir))))
ORACLES["curl_2d"] = _q.select({"v": f"({_q.d('v1', 0)}) - ({_q.d('v0', 1)})"})


def _with_index(fields):
    """The fields and ``x``, the first coordinate, as one more."""
    from fieldweave.field import Field

    f = fields["f"]
    shared = f.df.select("*", F.col("i0").cast("double").alias("x"))
    return {"f": Field(shared, f.shape), "x": Field(shared.select(*[c for c in shared.columns if c not in ("v", "x")], F.col("x").alias("v")), f.shape)}


_q = Sql(_G3)
register("gradient_nd", _G3, "gradient_nd(f)", _q.select({f"v{d}": _q.d("v", d) for d in range(3)}), boundary="periodic")
_q = Sql(_G3)
register("jacobian", _G3, "jacobian(w)", _q.select({f"m{c}{a}": _q.d(f"v{c}", a) for c in range(3) for a in range(3)}))
_first = Sql(_G3)
_first_sql = _first.cte({f"d{d}": _first.d("v", d) for d in range(3)})
_q = Sql(_G3, "g", f"g AS ({_first_sql})")
register("hessian", _G3, "hessian(f)", _q.select({f"m{a}{b}": _q.d(f"d{a}", b) for a in range(3) for b in range(3)}))
_unit = f"g AS ({_first_sql}), u AS (SELECT i0, i1, i2, " + ", ".join(f"d{d} / greatest(sqrt(d0*d0 + d1*d1 + d2*d2), 1e-15) AS u{d}" for d in range(3)) + " FROM g)"
_q = Sql(_G3, "u", _unit)
register("mean_curvature", _G3, "mean_curvature(f)", _q.select({"v": " + ".join(f"({_q.d(f'u{d}', d)})" for d in range(3))}))
_q = Sql(_P2)
_x, _y = (_q.d("v", d) for d in (0, 1))
_long = f"sqrt(({_x}) * ({_x}) + ({_y}) * ({_y}) + 1)"
register("surface_normals", _P2, "surface_normals(f)", _q.select({"v0": f"-({_x}) / {_long}", "v1": f"-({_y}) / {_long}", "v2": f"1 / {_long}"}))
_q = Sql(_G3)
register("material_derivative", _G3, "material_derivative(f, w)", _q.select({"v": " + ".join(f"f.v{d} * ({_q.d('v', d)})" for d in range(3))}))


def _passes(fixture: str, weights: list[float], boundary: str) -> str:
    """One weighted pass after another along each axis."""
    steps, source, r = [], "f", len(weights) // 2
    for d in range(len(_SHAPES[fixture])):
        q = Sql(fixture, source)
        steps.append(f"p{d} AS ({q.cte({'v': ' + '.join(f'{w} * {q.tap("v", d, k - r, boundary)}' for k, w in enumerate(weights))})})")
        source = f"p{d}"
    return Sql(fixture, source, ", ".join(steps)).select({"v": "f.v"})


register("conv3d_gauss27", _G3, "conv3d_spectral(f)", _passes(_G3, [0.25, 0.5, 0.25], "periodic"))
for _b in ("neumann", "reflect"):
    register(f"moving_average_{_b}", _G3, f'moving_average(f, window=3, boundary="{_b}")', _passes(_G3, [1 / 3] * 3, _b))
for _b in ("periodic", "neumann", "dirichlet", "reflect"):
    _at = {"periodic": "(f.i0 + o.x + 2499) % 2499", "neumann": "least(greatest(f.i0 + o.x, 0), 2498)", "dirichlet": "f.i0 + o.x"}.get(_b, "CASE WHEN f.i0 + o.x > 2498 THEN 4996 - f.i0 - o.x ELSE abs(f.i0 + o.x) END")
    _wide = f"WITH {_S1}, r AS (SELECT f.i0, sum(coalesce(g.v, 0.0)) / 101 AS v FROM f CROSS JOIN range(-50, 51) o(x) LEFT JOIN f g ON g.i0 = {_at} GROUP BY f.i0) SELECT i0, {rounded('v')} FROM r"
    register(f"moving_average_w101_{_b}", _S1, f'moving_average(f, window=101, boundary="{_b}")', _wide)
register("moving_average_w5", _S2, "moving_average(f, window=5)", _passes(_S2, [0.2] * 5, "neumann"))

# Components ----------------------------------------------------------------------------------------------

_norm = "greatest(sqrt(v0*v0 + v1*v1 + v2*v2), 1e-15)"
_long3 = "sqrt(v1*v1 + v2*v2 + 1)"
for _name, _expr, _sql in (
    ("stack", "stack_components(f, n)", {"v0": "v", "v1": "n"}),
    ("select", "select_component(w, index=2)", {"v": "v2"}),
    ("norm_last", "norm_last(w)", {"v": _norm}),
    ("div_last", "div_last(w, norm_last(w))", {f"v{d}": f"v{d} / {_norm}" for d in range(3)}),
    ("neg_stack3", "neg_stack3(select_component(w, index=1), select_component(w, index=2))", {"v0": f"-v1 / {_long3}", "v1": f"-v2 / {_long3}", "v2": f"1 / {_long3}"}),
    ("scale_eye", "scale_eye(f, D=3)", {f"m{r}{c}": "v" if r == c else "0.0 * v" for r in range(3) for c in range(3)}),
    ("velocity_dot_grad", "velocity_dot_grad(w, w)", {f"v{d}": f"v{d} * v{d}" for d in range(3)}),
    ("vector_arithmetic", "2 * w - w * f", {f"v{d}": f"2 * v{d} - v{d} * v" for d in range(3)}),
):
    register(f"component_{_name}", _G3, _expr, _cells(_G3, **_sql))

# Reductions and integrals --------------------------------------------------------------------------------

_all = "(SELECT unnest([v0, v1, v2]) AS x FROM f)"
for _name, _expr, _sql in (
    ("sum", "sum(f)", {"v": "sum(v)"}),
    ("mean", "mean(f)", {"v": "avg(v)"}),
    ("norm_l2", "norm_l2(f)", {"v": "sqrt(sum(v * v))"}),
    ("min_max", "min_max(f)", {"lo": "min(v)", "hi": "max(v)"}),
    ("variance", "variance(f)", {"v": "var_samp(v)"}),
    ("variance_pop", "var(f, unbiased=False)", {"v": "var_pop(v)"}),
    ("covariance", "cov(f, n)", {"v": "covar_samp(v, n)"}),
    ("correlation", "corr(f, n)", {"v": "covar_pop(v, n) * count(*) / (sqrt(var_pop(v) * count(*)) * sqrt(var_pop(n) * count(*)) + 1e-15)"}),
    ("correlation_constant", "corr(f, f * 0)", {"v": "0.0 * count(*)"}),
    ("surface_integral", "surface_integral(w, w, f)", {"v": "sum((v0*v0 + v1*v1 + v2*v2) * v)"}),
    ("combined", "sum(f) / mean(n) + 1", {"v": "sum(v) / avg(n) + 1"}),
):
    register(f"reduce_{_name}", _G3, _expr, _one(_G3, **_sql))
register("reduce_sum_vector", _G3, "sum(w)", f"WITH {_G3} SELECT round(3.3e-8 + sum(x), 6) + 0.0 AS v FROM {_all}")
register("reduce_entropy", _G3, "entropy(f)", f"WITH {_G3}, p AS (SELECT abs(v) / ((SELECT sum(abs(v)) FROM f) + 1e-15) AS p FROM f) SELECT round(3.3e-8 - sum(p * ln(p + 1e-15)), 6) + 0.0 AS v FROM p")


def _lines(aggregate: str, dim: int) -> str:
    rest = [d for d in range(3) if d != dim]
    return f"WITH {_G3} SELECT {', '.join(f'i{d} AS i{k}' for k, d in enumerate(rest))}, round(3.3e-8 + {aggregate}, 6) + 0.0 AS v FROM f GROUP BY {', '.join(f'i{d}' for d in rest)}"


register("reduce_sum_axis", _G3, "sum(f, dim=0)", _lines("sum(v)", 0))
register("reduce_mean_axis", _G3, "mean(f, dim=1)", _lines("avg(v)", 1))
register("reduce_variance_axis", _G3, "variance(f, dim=2)", _lines("var_samp(v)", 2))
register("reduce_entropy_axis", _G3, "entropy(f, dim=0)", f"WITH {_G3}, p AS (SELECT i1, i2, abs(v) / (sum(abs(v)) OVER (PARTITION BY i1, i2) + 1e-15) AS p FROM f) SELECT i1 AS i0, i2 AS i1, round(3.3e-8 - sum(p * ln(p + 1e-15)), 6) + 0.0 AS v FROM p GROUP BY i1, i2")
register("reduce_keepdim", _G3, "f - mean(f, dim=0, keepdim=True)", f"WITH {_G3} SELECT i0, i1, i2, round(3.3e-8 + v - avg(v) OVER (PARTITION BY i1, i2), 6) + 0.0 AS v FROM f")
register("reduce_center", _G3, "f - mean(f)", f"WITH {_G3} SELECT i0, i1, i2, round(3.3e-8 + v - (SELECT avg(v) FROM f), 6) + 0.0 AS v FROM f")


def _simpson(i: str, n: int, h: float) -> str:
    last = n - 1 if n % 2 else n - 2
    inner = f"CASE WHEN {i} = 0 OR {i} = {last} THEN {h / 3} WHEN {i} % 2 = 1 AND {i} < {last} THEN {4 * h / 3} WHEN {i} < {last} THEN {2 * h / 3} ELSE 0.0 END"
    return f"({inner})" if n % 2 else f"({inner} + CASE WHEN {i} >= {n - 2} THEN {h / 2} ELSE 0.0 END)"


def _trapezoid(i: str, n: int, h: float) -> str:
    return f"(CASE WHEN {i} = 0 OR {i} = {n - 1} THEN {h / 2} ELSE {h} END)"


register("integrate_simpson_odd", _S1, "integrate(f)", _one(_S1, v=f"sum(v * {_simpson('i0', 2499, 1.0)})"))
register("integrate_simpson_even", _S2, "integrate(f, dx=0.5)", _one(_S2, v=f"sum(v * {_simpson('i0', 720, 0.5)})"))
register("integrate_3d", _G3, "integrate(f, dx=0.1)", _one(_G3, v="sum(v * " + " * ".join(_simpson(f"i{d}", n, 0.1) for d, n in enumerate(fx.G3_SHAPE)) + ")"))
register("integrate_trapezoid", _G3, 'integrate(f, dx=0.1, method="trapezoid")', _one(_G3, v="sum(v * " + " * ".join(_trapezoid(f"i{d}", n, 0.1) for d, n in enumerate(fx.G3_SHAPE)) + ")"))
register("integrate_dims", _G3, "integrate(f, dims=(0, 2))", f"WITH {_G3} SELECT i1 AS i0, round(3.3e-8 + sum(v * {_simpson('i0', 50, 1.0)} * {_simpson('i2', 9, 1.0)}), 6) + 0.0 AS v FROM f GROUP BY i1")
_run = "coalesce(sum((v + before) / 2 * {h}) OVER (PARTITION BY {o} ORDER BY i{d}), 0.0)"
register("cumulative_integral", _G3, "cumulative_integral(f, dim=0, dx=0.5)", f"WITH {_G3}, g AS (SELECT *, lag(v) OVER (PARTITION BY i1, i2 ORDER BY i0) AS before FROM f) SELECT i0, i1, i2, round(3.3e-8 + {_run.format(h=0.5, o='i1, i2', d=0)}, 6) + 0.0 AS v FROM g")
register("cumulative_integral_1d", _S1, "cumulative_integral(f)", f"WITH {_S1}, g AS (SELECT *, lag(v) OVER (ORDER BY i0) AS before FROM f) SELECT i0, round(3.3e-8 + {_run.format(h=1.0, o='1', d=0)}, 6) + 0.0 AS v FROM g")

# Linear algebra ------------------------------------------------------------------------------------------


def _det_sql(m: Callable[[int, int], str]) -> str:
    return (
        f"({m(0, 0)} * ({m(1, 1)} * {m(2, 2)} - {m(1, 2)} * {m(2, 1)}) - {m(0, 1)} * ({m(1, 0)} * {m(2, 2)} - {m(1, 2)} * {m(2, 0)})"
        f" + {m(0, 2)} * ({m(1, 0)} * {m(2, 1)} - {m(1, 1)} * {m(2, 0)}))"
    )


_m = lambda r, c: f"m{r}{c}"
register("linalg_trace", _M3, "trace(m)", _cells(_M3, v="m00 + m11 + m22"))
register("linalg_determinant", _M3, "determinant(m)", _cells(_M3, v=_det_sql(_m)))
register("linalg_deviatoric", _M3, "deviatoric(m)", _cells(_M3, **{f"m{r}{c}": f"m{r}{c}" + (" - (m00 + m11 + m22) / 3" if r == c else "") for r in range(3) for c in range(3)}))
register("linalg_times_transposed", _M3, "matmul_batched_custom(m)", _cells(_M3, **{f"m{r}{c}": " + ".join(f"m{r}{k} * m{c}{k}" for k in range(3)) for r in range(3) for c in range(3)}))


def _inverse_sql() -> str:
    def minor(r, c):
        (a, b), (x, y) = [i for i in range(3) if i != r], [j for j in range(3) if j != c]
        return f"(m{a}{x} * m{b}{y} - m{a}{y} * m{b}{x})"

    return _cells(_M3I, **{f"m{r}{c}": f"{'-' if (r + c) % 2 else ''}{minor(c, r)} / {_det_sql(_m)}" for r in range(3) for c in range(3)})


register("linalg_inverse", _M3I, "inverse(m)", _inverse_sql())
_q_ = "(m00 + m11 + m22) / 3"
_eig = f"""WITH {_M3S}, a AS (SELECT *, {_q_} AS q, sqrt((power(m00 - {_q_}, 2) + power(m11 - {_q_}, 2) + power(m22 - {_q_}, 2) + 2 * (m10*m10 + m20*m20 + m21*m21)) / 6) AS p FROM f),
b AS (SELECT i0, q, p, acos(least(greatest({_det_sql(lambda r, c: f"((m{max(r, c)}{min(r, c)}{' - q' if r == c else ''}) / p)")} / 2, -1.0), 1.0)) / 3 AS t FROM a)
SELECT i0, round(3.3e-8 + q + 2 * p * cos(t + 2 * pi() / 3), 6) + 0.0 AS v0, round(3.3e-8 + q - 2 * p * (cos(t) + cos(t + 2 * pi() / 3)), 6) + 0.0 AS v1, round(3.3e-8 + q + 2 * p * cos(t), 6) + 0.0 AS v2 FROM b"""
register("linalg_eigenvalues", _M3S, "eigenvalues(m)", _eig)

# Spectral and geometry -----------------------------------------------------------------------------------


def _dft_sql() -> str:
    """The transform as direct sums, one axis after another."""
    steps, source = ["s AS (SELECT i0, i1, i2, v AS re, 0.0 AS im FROM f)"], "s"
    for d, n in enumerate(fx.G3_SHAPE):
        angle = f"(2 * pi() * ((k.x * s.i{d}) % {n}) / {n})"
        at = ", ".join(f"CAST(k.x AS INT) AS i{e}" if e == d else f"s.i{e}" for e in range(3))
        by = ", ".join("k.x" if e == d else f"s.i{e}" for e in range(3))
        steps.append(f"a{d} AS (SELECT {at}, sum(s.re * cos{angle} + s.im * sin{angle}) AS re, sum(s.im * cos{angle} - s.re * sin{angle}) AS im FROM {source} s, range({n}) k(x) GROUP BY {by})")
        source = f"a{d}"
    return f"WITH {_G3}, {', '.join(steps)} SELECT i0, i1, i2, {rounded('re')}, {rounded('im')} FROM {source}"


def _kernel_sql(axis: int, second: bool, dx: float) -> str:
    """A line's derivative as its convolution with the transform's kernel."""
    n = fx.G3_SHAPE[axis]
    freq = f"(2 * pi() * CASE WHEN k.x <= {(n - 1) // 2} THEN k.x ELSE k.x - {n} END / {n * dx})"
    wave = f"(2 * pi() * ((k.x * m.x) % {n}) / {n})"
    term = f"-{freq} * {freq} * cos{wave}" if second else f"-{freq} * sin{wave}"
    return f"(SELECT m.x AS m, sum({term}) / {n} AS w FROM range({n}) m(x), range({n}) k(x) GROUP BY m.x)"


def _convolve(axis: int, second: bool, dx: float) -> str:
    n, at = fx.G3_SHAPE[axis], ", ".join(f"f.i{d}" for d in range(3))
    same = " AND ".join(f"o.i{d} = f.i{d}" for d in range(3) if d != axis)
    return f"SELECT {at}, sum(o.v * k.w) AS v FROM f JOIN f o ON {same} JOIN {_kernel_sql(axis, second, dx)} k ON k.m = (f.i{axis} - o.i{axis} + {n}) % {n} GROUP BY {at}"


register("spectral_fft", _G3, "fft(f)", _dft_sql())
_dft_last = _dft_sql().rsplit(" SELECT ", 1)[0]
register("spectral_fft_forward", _G3, 'fft_complex(f, norm="forward")', f"{_dft_last}, z AS (SELECT i0, i1, i2, re / 4950 AS re, im / 4950 AS im FROM a2) SELECT i0, i1, i2, {rounded('re')}, {rounded('im')} FROM z")
_wave = "(2 * pi() * ((k.x * f.i0) % 2499) / 2499)"
register("spectral_fft_1d", _S1, "fft(f)", f"WITH {_S1}, r AS (SELECT CAST(k.x AS INT) AS i0, sum(f.v * cos{_wave}) AS re, -sum(f.v * sin{_wave}) AS im FROM f, range(2499) k(x) GROUP BY k.x) SELECT i0, {rounded('re')}, {rounded('im')} FROM r")
register("spectral_ifft", _G3, "ifft(f)", f"{_dft_last}, z AS (SELECT i0, i1, i2, re / 4950 AS v FROM a2) SELECT i0, i1, i2, {rounded('v')} FROM z")
register("spectral_roundtrip", _G3, "ifft(fft(f))", _cells(_G3, v="v"))
register("spectral_complex", _G3, 'ifft_complex(fft_complex(f, norm="ortho"), norm="ortho")', _cells(_G3, re="v", im="0.0 * v"))
register("spectral_gradient", _G3, "spectral_gradient(f, dim=1, dx=0.5)", f"WITH {_G3}, r AS ({_convolve(1, False, 0.5)}) SELECT i0, i1, i2, {rounded('v')} FROM r")
register("spectral_laplacian", _G3, "spectral_laplacian(f)", f"WITH {_G3}, r AS (SELECT i0, i1, i2, sum(v) AS v FROM (" + " UNION ALL ".join(f"({_convolve(d, True, 1.0)})" for d in range(3)) + f") GROUP BY i0, i1, i2) SELECT i0, i1, i2, {rounded('v')} FROM r")
_edt = " + ".join(f"(f.i{d} - o.i{d}) * (f.i{d} - o.i{d})" for d in range(3))
register("distance_transform", _G3, "distance_transform(k)", f"WITH {_G3}, o AS (SELECT * FROM f WHERE mask <> 0) SELECT f.i0, f.i1, f.i2, round(3.3e-8 + sqrt(CAST(min({_edt}) AS DOUBLE)), 6) + 0.0 AS v FROM f, o GROUP BY f.i0, f.i1, f.i2")

register("distance_transform_1d", _S1, "distance_transform(clamp(f - 1.2 * mean(f), lo=0, hi=99), dx=0.5)", f"WITH {_S1}, o AS (SELECT i0 FROM f WHERE v > 1.2 * (SELECT avg(v) FROM f)) SELECT f.i0, round(3.3e-8 + 0.5 * CAST(min(abs(f.i0 - o.i0)) AS DOUBLE), 6) + 0.0 AS v FROM f LEFT JOIN o ON true GROUP BY f.i0")

# Compiled expressions, storage and tiles -----------------------------------------------------------------

register("compile_div_grad", _G3, "divergence(gradient(f))", _laplacian(_G3, "periodic"), boundary="periodic")
_q = Sql(_G3)
_lap = "(" + " + ".join(f"{_q.tap('v', d, 1, 'periodic')} + {_q.tap('v', d, -1, 'periodic')} - 2 * f.v" for d in range(3)) + ")"
register("compile_shared", _G3, "laplacian(f)*laplacian(f) + laplacian(f)", _q.select({"v": f"{_lap} * {_lap} + {_lap}"}), boundary="periodic")
_q = Sql(_G3)
_lap = "(" + " + ".join(f"{_q.tap('v', d, 1, 'neumann')} + {_q.tap('v', d, -1, 'neumann')} - 2 * f.v" for d in range(3)) + ")"
register("compile_mixed", _G3, "laplacian(f) + a * f**2 - norm_last(gradient(f))", _q.select({"v": f"{_lap} + 0.5 * f.v * f.v - greatest(sqrt({' + '.join(f'power({_q.d("v", d)}, 2)' for d in range(3))}), 1e-15)"}), constants={"a": 0.5})
_first = Sql(_G3)
_twice = Sql(_G3, "g", "g AS (" + _first.cte({"v": " + ".join(f"{_first.tap('v', d, 1, 'periodic')} + {_first.tap('v', d, -1, 'periodic')} - 2 * f.v" for d in range(3))}) + ")")
register("compile_nested_stencil", _G3, "laplacian(laplacian(f))", _twice.select({"v": " + ".join(f"{_twice.tap('v', d, 1, 'periodic')} + {_twice.tap('v', d, -1, 'periodic')} - 2 * f.v" for d in range(3))}), boundary="periodic")


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_query("source_slice", f"WITH {_G3} SELECT i0 - 10 AS i0, i1, i2 - 2 AS i2, v FROM f WHERE i0 >= 10 AND i0 < 20 AND i2 >= 2 AND i2 < 5")
def _slice(spark, sf_dir):
    return fx.g3(spark, sf_dir)["f"].slice((10, 20), None, (2, 5)).df.select("i0", "i1", "i2", "v")


@_query("source_world", f"WITH {_G3} SELECT i0, i1, i2, 1.0 + i0 * 0.5 AS x0, 2.0 + i1 * 0.25 AS x1, i2 * 2.0 AS x2 FROM f")
def _world(spark, sf_dir):
    from dataclasses import replace

    return replace(fx.g3(spark, sf_dir)["f"], spacing=(0.5, 0.25, 2.0), origin=(1.0, 2.0, 0.0)).world().select("i0", "i1", "i2", "x0", "x1", "x2")


@_query(
    "source_ingest",
    "WITH raw AS (SELECT l_linenumber AS a, CAST(l_quantity AS INT) AS b, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) "
    "SELECT CAST(a.x AS INT) AS i0, CAST(b.x AS INT) AS i1, coalesce(v, 0.0) AS v FROM range(8) a(x) CROSS JOIN range(51) b(x) LEFT JOIN raw ON raw.a = a.x AND raw.b = b.x",
)
def _ingest(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.lit(1.0).alias("one"))
    return ingest(spark, lines, ("l_linenumber", "q"), "one", shape=(8, 51), spacing=1.0).df


@_query(
    "tiles_overlap",
    f"WITH {_P2}, p AS (SELECT f.*, a.x AS ta, b.x AS tb, f.i0 // 20 = a.x AND f.i1 // 10 = b.x AS own FROM f, range(3) a(x), range(3) b(x) "
    "WHERE f.i0 >= a.x * 20 - 2 AND f.i0 < a.x * 20 + 22 AND f.i1 >= b.x * 10 - 2 AND f.i1 < b.x * 10 + 12) SELECT ta * 3 + tb AS tile, count(*) AS cells, count(*) FILTER (WHERE NOT own) AS ghosts, round(sum(v), 6) AS total FROM p GROUP BY 1",
)
def _tiles(spark, sf_dir):
    cut = tiles(fx.p2(spark, sf_dir)["f"], (20, 10), overlap=2)
    return cut.groupBy("tile").agg(F.count("*").alias("cells"), F.count_if("ghost").alias("ghosts"), F.round(F.sum("v"), 6).alias("total"))


@_query(
    "decompose_overlap",
    f"WITH {_S1}, p AS (SELECT f.*, a.x AS part FROM f, range(4) a(x) WHERE f.i0 >= a.x * 625 - 3 AND f.i0 < a.x * 625 + 628) SELECT part, count(*) AS cells, round(sum(v), 6) AS total FROM p GROUP BY 1",
)
def _decompose(spark, sf_dir):
    cut = decompose_field(fx.s1(spark, sf_dir)["f"], parts=4, dim=0, overlap=3)
    return cut.groupBy("part").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 6).alias("total"))


# Storage and runs: the same SQL as the expressions have, over what was written and read back.


@_query("store_roundtrip", _cells(_G3, v="v"))
def _stored(spark, sf_dir):
    return tidy_frame(open_field(spark, save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field"))).df)


@_query("store_slice_eager", f"WITH {_G3} SELECT i0 - 10 AS i0, i1, i2, v FROM f WHERE i0 >= 10 AND i0 < 20")
def _stored_slice(spark, sf_dir):
    path = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field"))
    return load_field(spark, path, mode="auto").slice((10, 20)).df.select("i0", "i1", "i2", "v")


@_query("run_stream_execute", ORACLES["gradient_periodic"])
def _streamed(spark, sf_dir):
    path, out = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field")), work_path(spark, "gradient")
    stream_execute(spark, "grad", path, out, dx=0.5, boundary="periodic")
    return tidy_frame(open_field(spark, out).df)


@_query("run_stream_stats", "WITH " + _G3 + ", r AS (SELECT v * v + tanh(v) * exp(v) AS v FROM f) SELECT count(*) AS cells, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high, round(avg(v), 6) + 0.0 AS mean FROM r")
def _stream_stats(spark, sf_dir):
    got = run_to_store(spark, "f**2 + tanh(f)*exp(f)", {"f": fx.g3(spark, sf_dir)["f"]}, work_path(spark, "expression"))
    a, b, c = got["shape_out"]
    return spark.createDataFrame([(a * b * c, *(round(got[k], 6) + 0.0 for k in ("min", "max", "mean")))], "cells long, low double, high double, mean double")


@_query("run_pipeline", ORACLES["laplacian_neumann"])
def _run_pipeline(spark, sf_dir):
    from fieldweave.pipeline import Pipeline

    out = work_path(spark, "pipeline")
    p = Pipeline("laplacian", "f + a").set(boundary="neumann", output=out)
    p.f, p.a = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field")), 2.0
    p.run()
    return tidy_frame(open_field(spark, out).df)


@_query("run_registered_operator", _cells(_G3, v="v * v * v - 1"))
def _registered(spark, sf_dir):
    from fieldweave.plans.workspace import Value

    register_operator("cube_less_one", lambda ws, node, v: Value(v.kind, tuple(c * c * c - 1 for c in v.columns), v.size), replace=True)
    return tidy(evaluate("cube_less_one(f)", fx.g3(spark, sf_dir)))


# Slabs, storage by blocks, kernels of lines.


@_query("slabs_nested_stencil", ORACLES["compile_nested_stencil"])
def _slabs(spark, sf_dir):
    path, out = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field")), work_path(spark, "slabs")
    run_in_slabs(spark, "laplacian(laplacian(f))", {"f": path}, out, slab=20)
    return tidy_frame(open_field(spark, out).df.select("i0", "i1", "i2", "v"))


@_query("slabs_of_an_inner_axis", ORACLES["laplacian_neumann"])
def _slabs_inner(spark, sf_dir):
    path, out = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field"), blocks=(16, 4, 4)), work_path(spark, "slabs")
    run_in_slabs(spark, "laplacian(f) + laplacian(c * 0 * f)", {"f": path}, out, axis=1, slab=4, boundary="neumann", constants={"c": 3.0})
    return tidy_frame(open_field(spark, out).df.select("i0", "i1", "i2", "v"))


@_query("store_blocks", f"WITH {_G3} SELECT i0, i1 - 4 AS i1, i2 - 6 AS i2, v FROM f WHERE i1 >= 4 AND i1 < 7 AND i2 >= 6 AND i2 < 8")
def _stored_blocks(spark, sf_dir):
    path = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field"), blocks=(8, 4, 4))
    return open_field(spark, path).slice(None, (4, 7), (6, 8)).df.select("i0", "i1", "i2", "v")


def _running(values):
    """running sums of lines"""
    return values.cumsum(axis=1)


_running_sql = f"WITH {_G3}, r AS (SELECT i0, i1, i2, sum(v) OVER (PARTITION BY i0, i2 ORDER BY i1 ROWS UNBOUNDED PRECEDING) AS v FROM f) SELECT i0, i1, i2, {rounded('v')} FROM r"


@_query("run_line_kernel", _running_sql)
def _line_kernel(spark, sf_dir):
    register_operator("running_sum", line=_running, replace=True)
    return tidy(evaluate("running_sum(f, dim=1)", fx.g3(spark, sf_dir)))


@_query("run_sql_function", _running_sql)
def _sql_function(spark, sf_dir):
    register_operator("running_sum", line=_running, replace=True)
    register_sql_function(spark, "running_sum")
    fx.g3(spark, sf_dir)["f"].df.select("i0", "i1", "i2", "v").createOrReplaceTempView("g3_cells")
    return tidy_frame(spark.sql("SELECT * FROM running_sum(TABLE(g3_cells), 1)"))


@_query("sweep_power", f"WITH {_G3} SELECT a.x / 2.0 AS a, round(sum(exp(v * a.x / 2.0)), 6) + 0.0 AS v FROM f, range(3) a(x) GROUP BY 1")
def _sweep(spark, sf_dir):
    return sweep("sum(exp(f * a))", fx.g3(spark, sf_dir), "a", 0.0, 1.0, 3).select("a", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _bounded(name: str, cells: int) -> None:
    """A registered query once more, with lines and boxes of so few cells that they are laid out, convolved or cut into blocks."""
    whole = QUERIES[name]

    def run(spark, sf_dir):
        with bounded_lines(cells):
            return whole(spark, sf_dir)

    QUERIES[f"{name}_bounded"], ORACLES[f"{name}_bounded"] = run, ORACLES[name]


# 2499 = 49 * 51, and 51 = 3 * 17: with lines of 16 cells, axes are laid out as two twice and 17 is convolved with a chirp.
_bounded("spectral_fft_1d", 16)
_bounded("distance_transform", 4)
_bounded("moving_average_w101_reflect", 128)


# Graphs: several results of one frame.


def _three_sinks(spark, sf_dir):
    g = Graph()
    f = g.constant(fx.g3(spark, sf_dir)["f"], "f")
    g.add("laplacian", [f], node_id="lap")
    grad = g.add("gradient", [f], node_id="grad")
    g.add("norm_last", [grad], node_id="speed")
    g.add("sum", ["lap"], node_id="total")
    g.add("min_max", [f], node_id="range")
    return g


_graph = Sql(_G3)
_graph_columns = {
    "lap": " + ".join(f"{_graph.tap('v', d, 1, 'periodic')} + {_graph.tap('v', d, -1, 'periodic')} - 2 * f.v" for d in range(3)),
    **{f"grad_v{d}": _graph.d("v", d, 1.0, "periodic") for d in range(3)},
}
_graph_columns["speed"] = "sqrt(" + " + ".join(f"({_graph_columns[f'grad_v{d}']}) * ({_graph_columns[f'grad_v{d}']})" for d in range(3)) + ")"


@_query("graph_sinks", _graph.select(_graph_columns))
def _graph_sinks(spark, sf_dir):
    return tidy_frame(_three_sinks(spark, sf_dir).run(["lap", "grad", "speed"], boundary="periodic").frame())


@_query("graph_numbers", f"WITH {_G3}, r AS (SELECT (SELECT sum(lap) FROM ({_graph.cte({'lap': _graph_columns['lap']})})) AS total, min(v) AS range_lo, max(v) AS range_hi FROM f) SELECT {rounded('total')}, {rounded('range_lo')}, {rounded('range_hi')} FROM r")
def _graph_numbers(spark, sf_dir):
    return tidy_frame(_three_sinks(spark, sf_dir).run(["total", "range"], boundary="periodic").numbers())


@_query("graph_seed", f"WITH {_G3}, r AS (SELECT i0, i1, i2, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS speed FROM f) SELECT i0, i1, i2, {rounded('speed')} FROM r")
def _graph_seed(spark, sf_dir):
    """The gradient is given as a known field, and nothing below it is evaluated."""
    return tidy_frame(_three_sinks(spark, sf_dir).run(["speed"], seed={"grad": fx.g3(spark, sf_dir)["w"]}).frame())


@_query("graph_stored", _graph.select({"v": _graph_columns["lap"]}))
def _graph_stored(spark, sf_dir):
    kept = _three_sinks(spark, sf_dir).run(["lap", "grad"], boundary="periodic").save(work_path(spark, "results"))
    return tidy_frame(kept["lap"].df)


# Sweeps in one plan.


@_query("sweep_fifty_steps", f"WITH {_G3} SELECT a.x * 2e-2 AS a, {rounded('v')} FROM (SELECT a.x, sum(exp(v * (a.x * 2e-2))) AS v FROM f, range(51) a(x) GROUP BY 1) a")
def _sweep_many(spark, sf_dir):
    got = sweep("sum(exp(f * a))", fx.g3(spark, sf_dir), "a", 0.0, 1.0, 51)
    return tidy_frame(got.select((F.round(F.col("a") * 50) * 0.02).alias("a"), "v").withColumnRenamed("a", "i9")).withColumnRenamed("i9", "a")


@_query("sweep_of_reductions", f"WITH {_G3}, r AS (SELECT a.x AS a, var_samp(v * a.x) + sqrt(sum(v * v)) AS v FROM f, range(1, 4) a(x) GROUP BY 1) SELECT CAST(a AS DOUBLE) AS a, {rounded('v')} FROM r")
def _sweep_reductions(spark, sf_dir):
    got = sweep("variance(f * a - mean(f * a)) + norm_l2(f)", fx.g3(spark, sf_dir), "a", 1.0, 3.0, 3)
    return tidy_frame(got.withColumnRenamed("a", "i9")).withColumnRenamed("i9", "a")


@_query("sweep_of_cells", f"WITH {_G3}, l AS ({_graph.cte({'v': 'f.v', 'lap': _graph_columns['lap']})}), r AS (SELECT a.x AS a, i0, i1, i2, v * a.x + lap AS v FROM l, range(1, 4) a(x)) SELECT CAST(a AS DOUBLE) AS a, i0, i1, i2, {rounded('v')} FROM r")
def _sweep_cells(spark, sf_dir):
    """The laplacian does not depend on the number and is evaluated once."""
    got = sweep("f * a + laplacian(f)", fx.g3(spark, sf_dir), "a", 1.0, 3.0, 3, boundary="periodic")
    return tidy_frame(got.withColumnRenamed("a", "i9")).withColumnRenamed("i9", "a")


# HDF5.


@_query("hdf5_roundtrip", _cells(_G3, v="v"))
def _hdf5(spark, sf_dir):
    return tidy_frame(open_hdf5(spark, save_hdf5(fx.g3(spark, sf_dir)["f"], work_path(spark, "field") + ".h5")).df)


@_query("hdf5_slice", ORACLES["source_slice"])
def _hdf5_slice(spark, sf_dir):
    path = save_hdf5(fx.g3(spark, sf_dir)["f"], work_path(spark, "field") + ".h5")
    return open_hdf5(spark, path).slice((10, 20), None, (2, 5)).df.select("i0", "i1", "i2", "v")


@_query("hdf5_expression", ORACLES["laplacian_neumann"])
def _hdf5_expression(spark, sf_dir):
    path = save_hdf5(fx.g3(spark, sf_dir)["f"], work_path(spark, "field") + ".h5")
    return tidy(evaluate("laplacian(f + 2)", {"f": open_hdf5(spark, path)}))


# Matrices of more than three rows: elimination without exchanges of rows in SQL, and what eigenvalues must add up to.


def _matrices(size: int, cell: Callable[[int, int], str]) -> str:
    return "f AS (SELECT CAST(vec_id AS INT) AS i0, " + ", ".join(f"{cell(r, c)} AS m{r}{c}" for r in range(size) for c in range(size)) + " FROM embeddings)"


def _eliminated(size: int, cell: Callable[[int, int], str], inverse: bool) -> str:
    """Tables e0, e1, ... of Gaussian elimination column by column; the last holds ``det``, or the inverse as b00.."""
    at = [(r, c) for r in range(size) for c in range(size)]
    start = [f"m{r}{c} AS a{r}{c}" for r, c in at] + [f"{float(r == c)} AS b{r}{c}" for r, c in at if inverse]
    out = f"{_matrices(size, cell)}, e0 AS (SELECT i0, 1.0 AS det, {', '.join(start)} FROM f)"
    for k in range(size):
        columns = []
        for name in "ab" if inverse else "a":
            for r, c in at:
                below = r > k or inverse and r != k
                columns.append(f"{name}{r}{c} - a{r}{k} / a{k}{k} * {name}{k}{c} AS {name}{r}{c}" if below else f"{name}{r}{c} / a{k}{k} AS {name}{r}{c}" if inverse else f"{name}{r}{c}")
        out += f", e{k + 1} AS (SELECT i0, det * a{k}{k} AS det, {', '.join(columns)} FROM e{k})"
    return out


def _element(size: int, form: str) -> Callable[[int, int], str]:
    at = lambda r, c: f"CAST(embedding[{size * r + c + 1}] AS DOUBLE)"
    shift = lambda r, c: f" + {2.0 if r == c else 0.0}"
    return {"shifted": lambda r, c: at(r, c) + shift(r, c), "raised": lambda r, c: f"({at(r, c)} + {at(c, r)}) / 2" + shift(r, c)}[form]


def _of_size(size: int) -> None:
    shifted, raised = _element(size, "shifted"), _element(size, "raised")

    @_query(f"linalg_determinant_{size}", f"WITH {_eliminated(size, shifted, False)} SELECT i0, {rounded('v')} FROM (SELECT i0, det AS v FROM e{size})")
    def determinant(spark, sf_dir):
        return tidy(evaluate("determinant(m)", fx.m3(spark, sf_dir, "shifted", size)))

    names = [f"m{r}{c}" for r in range(size) for c in range(size)]
    renamed = ", ".join(f"b{n[1:]} AS {n}" for n in names)

    @_query(f"linalg_inverse_{size}", f"WITH {_eliminated(size, shifted, True)}, r AS (SELECT i0, {renamed} FROM e{size}) SELECT i0, {', '.join(rounded(n) for n in names)} FROM r")
    def inverse(spark, sf_dir):
        return tidy(evaluate("inverse(m)", fx.m3(spark, sf_dir, "shifted", size)))

    power = {1: " + ".join(f"m{r}{r}" for r in range(size)), 2: " + ".join(f"m{r}{c} * m{c}{r}" for r in range(size) for c in range(size))}
    power[3] = " + ".join(f"m{r}{c} * m{c}{k} * m{k}{r}" for r in range(size) for c in range(size) for k in range(size))
    sums = ", ".join(f"{e} AS p{n}" for n, e in power.items())

    @_query(
        f"linalg_eigenvalues_{size}",
        f"WITH {_eliminated(size, raised, False)}, r AS (SELECT f.i0, {sums}, e{size}.det AS product FROM f JOIN e{size} ON f.i0 = e{size}.i0) SELECT i0, {', '.join(rounded(c) for c in ('p1', 'p2', 'p3', 'product'))}, TRUE AS rising FROM r",
    )
    def eigenvalues(spark, sf_dir):
        """Sums of the eigenvalues' powers, their product, and whether they rise."""
        v = [F.col(f"v{k}") for k in range(size)]
        found = evaluate("eigenvalues(m)", fx.m3(spark, sf_dir, "raised", size)).df
        sums = [sum((x**n for x in v[1:]), v[0] ** n).alias(f"p{n}") for n in (1, 2, 3)]
        product, rising = v[0], F.lit(True)
        for a, b in zip(v, v[1:]):
            product, rising = product * b, rising & (a <= b)
        out = found.select("i0", *sums, product.alias("product"), rising.alias("rising"))
        return tidy_frame(out.drop("rising")).join(out.select("i0", "rising"), "i0")


for _size in (3, 4, 8):
    _of_size(_size)


@_query("run_hdf5_to_hdf5", ORACLES["laplacian_neumann"])
def _hdf5_run(spark, sf_dir):
    path, out = save_field(fx.g3(spark, sf_dir)["f"], work_path(spark, "field") + ".h5"), work_path(spark, "laplacian") + ".h5"
    stream_execute(spark, "laplacian", path, out, boundary="neumann")
    return tidy_frame(open_field(spark, out).df)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression by which field engines are usually compared, with a stencil beside it."""
    return tidy(evaluate("f**2 + tanh(f)*exp(f) + laplacian(f)", fx.g3(spark, sf_dir), boundary="periodic"))


