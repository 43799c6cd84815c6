"""All queries of this engine but those of optional subpackages."""

from __future__ import annotations

from talkspan.plans import intervals, recordings, segmentation, signals, statistics, tables, texts  # noqa: F401  importing a module registers its queries
from talkspan.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
