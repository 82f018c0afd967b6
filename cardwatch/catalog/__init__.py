"""Every operator as a named query over the given tables, with its SQL check."""

from cardwatch.catalog.oracle import ORACLE
from cardwatch.catalog.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
