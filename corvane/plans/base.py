"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable


class Part:
    """Queries of one area. The SQL twin is given with the query, so that the two stay together."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(f: Callable) -> Callable:
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return register
