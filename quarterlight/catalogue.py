"""Query catalogue: a Spark query and, where SQL can say it, an oracle for each name."""

from __future__ import annotations

from .plans import evidence, oracles, review, surface
from .plans.queries import ALL


def queries() -> dict:
    return {f.__name__: f for f in [*ALL, *evidence.QUERIES, *surface.QUERIES, *review.QUERIES]}


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | evidence.sql() | surface.sql() | review.sql()
