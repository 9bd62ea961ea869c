"""Names of the queries, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name, with the SQL of the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from . import filters, groups, jobs, near, scalars, verdicts  # noqa: F401


load()
