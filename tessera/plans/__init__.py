"""The registered queries of the library."""

from tessera.plans import analytics, library, numeric, quantized, retrieval, verification, whole  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
