"""All registered queries of the bilingual-text engine."""

from __future__ import annotations

from lexibridge.plans import alignment, boxes, dashboard, guides, lists, memory, numbers, quality_rules, repetition, segments, state, streams, terminology  # noqa: F401
from lexibridge.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
