"""Every query of the library, in one place."""

from msgloom.queries import curation, flows, messages, workloads  # noqa: F401  they register their queries
from msgloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
