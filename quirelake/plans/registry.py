"""All queries by name, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register fn(tables) -> DataFrame as name. views: the role tables that sql reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _closed(views.split()))
            body = sql.strip()
            if ctes:
                recursive = body.upper().startswith("WITH RECURSIVE")
                body = f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{body.split(None, 2 if recursive else 1)[-1]}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"
            ORACLES[name] = body
        return fn

    return register


def _closed(names: list[str]) -> list[str]:
    """names with the views that they read, each after what it reads."""
    import re

    out: list[str] = []

    def add(name: str) -> None:
        if name in out:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                add(other)
        out.append(name)

    for n in names:
        add(n)
    return out


for _module in ("relational", "joins", "stats", "windows", "texts", "retrieval", "mining", "recommendation", "documents"):
    importlib.import_module(f"quirelake.plans.{_module}")
