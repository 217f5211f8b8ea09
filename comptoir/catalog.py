"""All registered queries of the decision-support engine with their DuckDB SQL."""

from comptoir.plans.queries import ORACLES, QUERIES
from comptoir.plans.queries import entry as ENTRY

__all__ = ["ENTRY", "ORACLES", "QUERIES"]
