"""Self-checks that a user can run on a session: do transforms invert, do operators obey the identities that define them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldweave.field import from_function
from fieldweave.plans.evaluate import evaluate

#: Largest error of a round trip, and of an identity beside the size of its terms.
ROUND_TRIP, IDENTITY = 1e-10, 1e-9


def noise(spark: SparkSession, shape: tuple[int, ...], seed: int = 0):
    """A field of normal numbers that depend on the place of a cell alone."""
    place = [F.col(f"i{d}") for d in range(len(shape))]
    uniform = lambda k: (F.pmod(F.xxhash64(*place, F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return from_function(spark, shape, F.sqrt(-2 * F.log(uniform(0))) * F.cos(uniform(1) * (2 * 3.141592653589793)))


def validate_fft_consistency(spark: SparkSession, shape: tuple[int, ...] = (64, 64), norms=("backward", "ortho", "forward"), tolerance: float = ROUND_TRIP) -> dict[str, float]:
    """The largest error of a transform and its inverse, by norm; an error beyond the tolerance raises."""
    f, out = noise(spark, shape), {}
    for norm in norms:
        low, high = evaluate(f'min_max(ifft(fft(f, norm="{norm}"), norm="{norm}") - f)', {"f": f}).value
        out[norm] = max(abs(low), abs(high))
    return _within(out, tolerance)


def validate_operator_identities(spark: SparkSession, shape: tuple[int, ...] = (32, 32), tolerance: float = IDENTITY) -> dict[str, float]:
    """Largest errors of identities that hold on any field, smooth or not, beside the largest term; one beyond the tolerance raises.

    The divergence of the gradient is the sum of second differences over two cells, the sum of a periodic laplacian and of periodic derivatives is 0, and the mean
    of a periodic moving average is the field's.
    """
    f = {"f": noise(spark, shape)}
    wrap = 'boundary="periodic"'
    terms = " + ".join(f"gradient(gradient(f, dim={d}, {wrap}), dim={d}, {wrap})" for d in range(len(shape)))
    two = {
        "divergence_of_gradient": (f"norm_l2(divergence(gradient(f, {wrap}) * 1, {wrap}) - ({terms}))", f"norm_l2({terms})"),
        "sum_of_laplacian": (f"sum(laplacian(f, {wrap}))", f"norm_l2(laplacian(f, {wrap}))"),
        "sum_of_derivatives": (f"sum(gradient(f, dim=0, {wrap}))", f"norm_l2(gradient(f, dim=0, {wrap}))"),
        "mean_of_average": (f"mean(moving_average(f, window=3, {wrap})) - mean(f)", "norm_l2(f)"),
    }
    return _within({k: abs(evaluate(a, f).value) / evaluate(b, f).value for k, (a, b) in two.items()}, tolerance)


def _within(errors: dict[str, float], tolerance: float) -> dict[str, float]:
    if bad := {k: e for k, e in errors.items() if not e <= tolerance}:
        raise AssertionError(f"beyond {tolerance}: {bad}")
    return errors
