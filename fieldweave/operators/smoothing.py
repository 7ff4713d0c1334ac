"""Box means of windows of any width, along one axis, at a cost that does not depend on the width.

Lines are cut into blocks as long as the window. A window then is the end of one block and the beginning of the next, so running sums
from either end of every block give its sum by one addition: no cell is summed twice, and no large totals are subtracted from each other. Ends of lines:
``dirichlet`` adds nothing, ``neumann`` adds the end cell as often as the window passes it, ``periodic`` and ``reflect`` lengthen
the line by copies of its cells. A line beyond the bound of ``lines`` is dealt to stretches that share as many cells as a window reaches, so it meets in no
task; if the window itself is longer than that, block totals are carried along the line and each cell looks two running totals up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldweave.functions.registry import register_operator
from fieldweave.operators.lines import line_cells
from fieldweave.operators.stencil import BOUNDARIES
from fieldweave.plans.expression import ExpressionError, Node, call
from fieldweave.plans.workspace import Value, Workspace

#: From the first row of a partition to the current one, and all of its rows.
SO_FAR, ALL = (W.unboundedPreceding, W.currentRow), (W.unboundedPreceding, W.unboundedFollowing)


def _places(i: Column, n: int, before: int, after: int, boundary: str) -> list[tuple[Column, Column]]:
    """Where a cell stands on its line lengthened by ``before`` and ``after`` cells: its own place first, then its copies' with their conditions."""
    out = [(F.lit(True), i + before)]
    if boundary == "periodic":
        return out + [(i >= n - before, i - n + before)] * (before > 0) + [(i < after, i + n + before)] * (after > 0)
    if boundary == "reflect" and before:
        out += [(i.between(1, before), F.lit(before) - i), (i.between(n - 1 - after, n - 2), F.lit(2 * (n - 1) + before) - i)]
    return out


def _stretched(df: DataFrame, d: int, value: str, n: int, before: int, after: int, low: int, high: int, boundary: str) -> DataFrame:
    """``df`` with _j (place on the lengthened line), _s (stretch) and _own; copies hold the value and the other coordinates only."""
    places = _places(F.col(f"i{d}").cast("long"), n, before, after, boundary)
    bound = line_cells()
    stretches = -(-(n + before + after) // bound)
    if len(places) == 1 and stretches == 1:
        return df.select("*", places[0][1].alias("_j"), F.lit(0).alias("_s"), F.lit(True).alias("_own"))
    stretch_of = lambda j: F.floor(j / bound).cast("long")

    def sent(has: Column, j: Column, own: bool) -> Column:
        """A place's rows: one in each stretch with a cell whose window holds it."""
        first, last = F.greatest(stretch_of(j - max(high, 0)), F.lit(0)), F.least(stretch_of(j + max(low, 0)), F.lit(stretches - 1))
        row = lambda s: F.struct(j.cast("long").alias("j"), s.cast("long").alias("s"), ((s == stretch_of(j)) & F.lit(own)).alias("own"))
        rows = F.transform(F.sequence(first, last), row)
        return F.when(has, rows).otherwise(F.slice(rows, 1, 0))

    copies = [sent(has, j, k == 0) for k, (has, j) in enumerate(places)]
    spread = df.select("*", F.explode(F.concat(*copies)).alias("_c"))
    kept = [F.col(c) if c == value or (c.startswith("i") and c != f"i{d}") else F.when(F.col("_c.own"), F.col(c)).alias(c) for c in df.columns]
    return spread.select(*kept, F.col("_c.j").alias("_j"), F.col("_c.s").alias("_s"), F.col("_c.own").alias("_own"))


def window_sums(df: DataFrame, shape: tuple[int, ...], d: int, value: str, window: int, boundary: str, result: str) -> DataFrame:
    """``df`` with a column of the sums over windows centred on each cell; the window itself, or the line, is within the bound."""
    n, reach = shape[d], window // 2
    others = [f"i{e}" for e in range(len(shape)) if e != d]
    laps, size, low = (*divmod(window, n), reach % n) if boundary == "periodic" else (0, window, reach)
    before, after = 0, 0
    if boundary == "reflect":
        before = after = min(reach, n - 1)
    elif boundary == "periodic" and size:
        before, after = low, max(0, size - 1 - low)
    high = size - 1 - low
    line = [*others, "_s"]
    cells = _stretched(df, d, value, n, before, after, low, high, boundary).withColumn("_k", F.floor(F.col("_j") / max(size, 1))).repartition(*line)
    v, j = F.col(value), F.col("_j")
    block, along = W.partitionBy(*line, "_k"), W.partitionBy(*line).orderBy("_k", "_j")
    sums = cells.select(
        "*",
        F.sum(v).over(block.orderBy(F.desc("_j")).rowsBetween(*SO_FAR)).alias("_tail"),
        F.sum(v).over(block.orderBy("_j").rowsBetween(*SO_FAR)).alias("_head"),
    )
    whole = F.sum(F.when(F.col("_own"), v)).over(along.rowsBetween(*ALL)) * laps if laps else F.lit(0.0)
    if not size:
        return sums.select(*df.columns, whole.alias(result), "_own").where("_own").drop("_own")
    shift = lambda column, by: column if not by else F.lead(column, by).over(along) if by > 0 else F.lag(column, -by).over(along)
    last, end = n + before + after - 1, F.last(v).over(along.rowsBetween(*ALL))
    head = F.coalesce(shift(F.col("_head"), high), F.last("_head").over(along.rowsBetween(*ALL)))
    tail = shift(F.col("_tail"), -low)
    a, b = j - low, F.least(j + high, F.lit(last))
    total = F.when((a <= 0) | (F.pmod(a, F.lit(size)) == 0), head).when(F.floor(a / size) == F.floor(b / size), tail).otherwise(tail + head)
    if boundary in ("neumann", "reflect"):
        past = lambda by, edge: F.when(by > 0, by * edge).otherwise(F.lit(0.0))
        total = total + past(-a, F.first(v).over(along.rowsBetween(*ALL))) + past(j + high - last, end)
    return sums.select(*df.columns, (total + whole).alias(result), "_own").where("_own").drop("_own")


def long_window_sums(df: DataFrame, shape: tuple[int, ...], d: int, value: str, window: int, boundary: str, result: str) -> DataFrame:
    """As ``window_sums`` for windows and lines of any length: differences of running totals, each looked up by its place."""
    n, reach, i = shape[d], window // 2, f"i{d}"
    others = [f"i{e}" for e in range(len(shape)) if e != d]
    own = df.select(*others, F.col(i).cast("long").alias("_p"), F.col(value).alias("_v"), F.floor(F.col(i) / line_cells()).alias("_s"))
    blocks = own.groupBy(*others, "_s").agg(F.sum("_v").alias("_t"), F.max_by("_v", "_p").alias("_z"), F.min_by("_v", "_p").alias("_a"))
    by_line = W.partitionBy(*others).orderBy("_s")
    blocks = blocks.select(
        *others,
        "_s",
        F.coalesce(F.sum("_t").over(by_line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_carried"),
        F.sum("_t").over(by_line.rowsBetween(*ALL)).alias("_all"),
        F.first("_a").over(by_line.rowsBetween(*ALL)).alias("_first"),
        F.last("_z").over(by_line.rowsBetween(*ALL)).alias("_last"),
    )
    running = F.sum("_v").over(W.partitionBy(*others, "_s").orderBy("_p").rowsBetween(*SO_FAR))
    # Running totals by the number of cells they hold, 1 to n; that of no cell is 0.
    totals = own.select("*", running.alias("_run")).join(blocks.select(*others, "_s", "_carried"), [*others, "_s"]).select(*others, (F.col("_p") + 1).alias("_p"), (F.col("_run") + F.col("_carried")).alias("_total"))
    whole, first, last = F.col("_all"), F.col("_first"), F.col("_last")

    def up_to(x: Column) -> tuple[Column, Column, Column]:
        """The sum of the endless line's cells from 0 to before ``x`` (negative: of those from x on, less them): a sign, the place of a running total, and a rest."""
        inside = (F.lit(1.0), x, F.lit(0.0))
        if boundary == "dirichlet":
            return F.lit(1.0), F.greatest(F.lit(0), F.least(x, F.lit(n))), F.lit(0.0)
        if boundary == "periodic":
            return F.lit(1.0), F.pmod(x, F.lit(n)), F.floor(x / n) * whole
        left, right = -x, x - n
        if boundary == "neumann":
            sides = (F.lit(1.0), F.lit(0), -left * first), (F.lit(1.0), F.lit(n), right * last)
        else:
            m, over = F.least(left, F.lit(n - 1)), F.greatest(left - (n - 1), F.lit(0))
            one = (F.lit(-1.0), m + 1, first - over * last)
            m, over = F.least(right, F.lit(n - 1)), F.greatest(right - (n - 1), F.lit(0))
            sides = one, (F.lit(-1.0), F.lit(n - 1) - m, whole + (whole - last) + over * first)
        return tuple(F.when(x < 0, s0).when(x > n, s1).otherwise(s) for s0, s1, s in zip(sides[0], sides[1], inside))

    cells = df.withColumn("_s", F.floor(F.col(i) / line_cells())).join(blocks.drop("_carried"), [*others, "_s"])
    place, parts = F.col(i).cast("long"), []
    for name, x in (("_hi", place + (reach + 1)), ("_lo", place - reach)):
        sign, at, rest = up_to(x)
        cells = cells.select("*", at.cast("long").alias(name), sign.alias(f"{name}s"), rest.alias(f"{name}r"))
        found = totals.select(*[F.col(c) for c in others], F.col("_p").alias(name), F.col("_total").alias(f"{name}t"))
        cells = cells.join(found, [*others, name], "left")
        parts.append(F.col(f"{name}s") * F.coalesce(F.col(f"{name}t"), F.lit(0.0)) + F.col(f"{name}r"))
    return cells.select(*df.columns, (parts[0] - parts[1]).alias(result))


def _box_mean(ws: Workspace, node: Node, v: Value) -> Value:
    """mean of a window of any odd width along one axis"""
    if not isinstance(v, Value) or v.kind != "scalar":
        raise ExpressionError("moving_average needs a scalar field")
    window, d, boundary = node.param("window"), node.param("axis"), node.param("boundary")
    (column,) = ws.keep(v.column)
    sums = window_sums if min(window, ws.shape[d]) <= line_cells() and (window < ws.shape[d] or ws.shape[d] <= line_cells()) else long_window_sums
    result = ws.fresh()
    ws.df = sums(ws.df, ws.shape, d, ws.name_of(column), window, boundary, result)
    return Value("scalar", (F.col(result) / F.lit(float(window)),))


def _lower_moving_average(node: Node, ndim: int) -> Node:
    """Separable box mean of an odd window of any width along every axis."""
    window, boundary = node.param("window", 3), node.param("boundary", "neumann")
    if boundary not in BOUNDARIES:
        raise ExpressionError(f"unknown boundary {boundary!r}; known are {BOUNDARIES}")
    if not isinstance(window, int) or window < 1 or window % 2 == 0:
        raise ExpressionError("moving_average needs an odd window")
    if ndim > 3:
        raise ExpressionError("moving_average takes at most three axes")
    out = node.args[0]
    for d in range(ndim if window > 1 else 0):
        out = call("box_mean", out, window=window, axis=d, boundary=boundary)
    return out


register_operator("box_mean", _box_mean, cost="medium")
register_operator("moving_average", lower=_lower_moving_average, radius=1, cost="medium")
