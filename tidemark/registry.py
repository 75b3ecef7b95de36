"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that define QUERIES (name -> function) and ORACLE_SQL (name -> SQL).
MODULES: tuple[str, ...] = ("tidemark.plans.coding", "tidemark.plans.texts", "tidemark.plans.probes", "tidemark.plans.ledger", "tidemark.plans.events", "tidemark.plans.media", "tidemark.plans.runs")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        found = getattr(import_module(name), attribute)
        if clash := out.keys() & found.keys():
            raise ValueError(f"{name}: defined twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
