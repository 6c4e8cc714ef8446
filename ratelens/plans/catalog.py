"""All registered queries."""

from __future__ import annotations

from ratelens.plans import cleaning, exploration, features, modeling, publishing, quality
from ratelens.plans.common import Query


def all_queries() -> dict[str, Query]:
    """Queries by name, in inventory order."""
    out: dict[str, Query] = {}
    for module in (publishing, quality, cleaning, exploration, features, modeling):
        out.update(module.QUERIES)
    return out
