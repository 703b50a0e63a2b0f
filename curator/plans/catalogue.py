"""The engine's own query catalogue."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = [import_module(f"curator.plans.{name}") for name in ("admission", "gates", "packing", "mixture", "ledger", "learning", "streams", "storage", "streaming", "verifier")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in PARTS for k, sql in part.SQL.items()}
