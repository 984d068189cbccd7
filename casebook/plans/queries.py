"""All registered queries of the incident operators, with their DuckDB SQL."""

from casebook.plans import analysis, ingest  # noqa: F401  registers them
from casebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
