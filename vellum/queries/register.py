"""The decorator by which query modules register."""

from __future__ import annotations


def registry():
    """(queries, oracles, decorator): the decorator takes the SQL, or nothing where SQL can't express the query."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
