"""All queries by name, and their DuckDB SQL."""

from planlens.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
