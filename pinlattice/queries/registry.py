"""Query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinlattice.queries.adapters import ADAPTERS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MODULES = (
    "sources",
    "projections",
    "joins",
    "aggregates",
    "windows",
    "topk_sets",
    "features",
    "models",
    "advice",
    "streams",
)


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register ``f(tables) -> DataFrame``; ``needs`` names adapter views used by the SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            views = ", ".join(f"{v} as ({duck(v)})" for v in needs.split())
            text = sql.strip()
            if views:
                if text.startswith("with recursive "):
                    text = f"with recursive {views}, {text[15:]}"
                elif text.startswith("with "):
                    text = f"with {views}, {text[5:]}"
                else:
                    text = f"with {views} {text}"
            ORACLES[name] = text
        return f

    return register


def duck(view: str) -> str:
    return ADAPTERS[view].strip()


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"pinlattice.queries.{module}")
