"""The operator registry and its extension surface."""

from fieldweave.functions.registry import REGISTRY, Operator, capability_report, operator, register_operator  # noqa: F401
