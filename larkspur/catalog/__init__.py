"""Every query of the engine by name, with DuckDB SQL of the same result."""

from larkspur.catalog import analytic, basics, changes, dialect, relational  # noqa: F401
from larkspur.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
