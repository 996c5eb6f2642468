"""Registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import frame_queries, manifest_queries, registry, score_queries, signal_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
