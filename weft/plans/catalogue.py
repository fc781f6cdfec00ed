"""All queries over the driver's tables."""

from __future__ import annotations

from weft.plans import corpus, evaluation, files, frames, layouts, scores, streams  # noqa: F401  each module registers its queries
from weft.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
