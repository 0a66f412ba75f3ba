"""A place for queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from labelloom.sources.views import with_views


class Registry:
    @staticmethod
    def new() -> tuple[dict, dict, Callable]:
        """Queries, SQL and a decorator that registers a query and its SQL over the named views."""
        queries: dict = {}
        sql: dict[str, str] = {}

        def query(name: str, text: str | None = None, views: tuple[str, ...] = ()):
            def keep(f):
                queries[name] = f
                if text:
                    sql[name] = with_views(text, *views)
                return f

            return keep

        return queries, sql, query
