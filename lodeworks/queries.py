"""All core queries and their DuckDB counterparts."""

from lodeworks.catalog import codes, dedup, execution, formulas, kernels, ledger, manifest, samples, texts  # noqa: F401
from lodeworks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
