"""Operators on fields; importing this registers them all."""

from fieldweave.operators import linalg, lines, pointwise, reduce, smoothing, stencil  # noqa: F401
