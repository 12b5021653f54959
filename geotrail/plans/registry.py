"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from geotrail.plans import extras, history, problems, routes, views

FLAGSHIP = "p1_found"
_MODULES = (problems, history, routes, extras, views)


def queries() -> dict[str, Callable]:
    """Name to ``(spark, sf_dir) -> DataFrame``."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL over the same tables."""
    return {k: q for m in _MODULES for k, q in getattr(m, "ORACLES", {}).items()}
