"""The registered queries: each with its Spark job and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from tablegauge.queries import (
    metric_queries,
    profile_queries,
    rule_queries,
    run_queries,
    scalar_queries,
    source_queries,
    version_queries,
)
from tablegauge.queries.support import Query

MODULES = (
    source_queries,
    scalar_queries,
    profile_queries,
    metric_queries,
    rule_queries,
    run_queries,
    version_queries,
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"query registered twice: {query.name}")
            found[query.name] = query
    return found
