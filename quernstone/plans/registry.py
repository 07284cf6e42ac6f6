"""All queries of the engine itself, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans import handles, links, names, pages, reports, shaping, skewed, streams, upkeep

_MODULES = (skewed, pages, links, handles, names, reports, shaping, streams, upkeep)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
