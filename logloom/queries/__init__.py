"""Queries over the given tables, with the SQL that gives the same rows."""

from logloom.queries import checks, contract, fields, graphs, parsing, stage  # noqa: F401
from logloom.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
