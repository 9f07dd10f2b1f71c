"""The table of queries."""

from __future__ import annotations

from ..fixtures import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *views: str):
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL of the same rows over the views."""

    def keep(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = with_views(body, *views)
        return f

    return keep
