"""Registry of the query catalogue: every query beside the SQL it is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules under ``viaduct.plans`` that hold ``QUERIES`` and ``ORACLE_SQL``.
MODULES: list[str] = ["feed", "graph", "scalars", "streams", "places", "manifests", "shapes", "views", "artifacts", "sources"]


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"viaduct.plans.{name}"), attribute)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
