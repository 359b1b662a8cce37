"""Registered queries: one per operator, with the equivalent DuckDB SQL where there is one."""

from pinlattice.queries.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
