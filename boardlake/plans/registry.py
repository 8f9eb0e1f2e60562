"""Query registry: a Spark callable and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .proxies import CTE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}  # without the shared table expressions


def _needed(text: str, seen: list[str]) -> list[str]:
    for name, body in CTE.items():
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the shared table expressions it mentions."""
    sql = sql.strip()
    parts = [f"{n} AS ({CTE[n]})" for n in _needed(sql, [])]
    if not parts:
        return sql
    head = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else "WITH "
    own = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
    if own != sql:
        return head + ", ".join(parts) + ", " + own
    return head + ", ".join(parts) + " " + sql


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco
