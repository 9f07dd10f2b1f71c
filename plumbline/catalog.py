"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .queries.registry import QUERIES, SQL

MODULES = ("provenance", "structured", "triage", "texts", "metrics", "agreement", "joins", "perturbation", "selection", "pipelines")


def _load() -> None:
    for name in MODULES:
        import_module(f"plumbline.queries.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
