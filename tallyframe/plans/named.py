"""Registering queries with their SQL."""

from __future__ import annotations


def book() -> tuple[dict, dict, object]:
    """Two dictionaries, and a decorator that files a query and its SQL under the function's name."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def file(function):
            queries[function.__name__] = function
            if sql:
                oracle[function.__name__] = sql
            return function

        return file

    return queries, oracle, query
