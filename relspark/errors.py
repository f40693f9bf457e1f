"""Typed errors.  Nothing else is raised for a malformed schema, query, parameter or write."""

from __future__ import annotations


class RelsparkError(Exception):
    """Base of all errors; ``code`` names the case."""

    def __init__(self, code: str, message: str = "", **details):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.details = code, details


class SchemaError(RelsparkError):
    """A declaration that is refused."""


class QueryError(RelsparkError):
    """A query that ``prepare`` refuses."""


class BindError(RelsparkError):
    """Parameters that don't fit the query."""


class ExecutionError(RelsparkError):
    """Overflow, a measure of an unbounded interval, or a spent recursion budget."""


class StoreError(RelsparkError):
    """A store that can't be opened, written or moved as asked."""
