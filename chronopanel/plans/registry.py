"""The query registry: ``@query(sql)`` registers a callable under its name."""

from __future__ import annotations

from chronopanel.sources.fixtures import BASE

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) callable; ``sql`` follows the fixtures' WITH list, starting with SELECT or with more CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLES[f.__name__] = f"WITH RECURSIVE {BASE}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
        return f

    return add
