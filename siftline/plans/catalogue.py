"""All queries of the core and their SQL."""

from __future__ import annotations

from siftline.plans import ranking, snapshots, tables, texts

_MODULES = [ranking, snapshots, tables, texts]


def flagship(spark, sf_dir):
    """Unified search, the whole ranked list."""
    return ranking.QUERIES["unified_search"](spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
