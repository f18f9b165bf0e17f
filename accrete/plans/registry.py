"""Queries over the test tables by name, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from accrete.plans import analysis, choosing, evaluating, more, preparing, running, scanning, scores, storing, triggering  # noqa: E402, F401
