"""All registered queries and oracles."""

from __future__ import annotations

from . import (  # noqa: F401
    artifact_queries,
    catalog_queries,
    drift_queries,
    import_queries,
    queue_queries,
    scalar_queries,
    stream_queries,
)
from .views import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
