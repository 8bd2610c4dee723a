"""The registered queries of the engine proper and their SQL oracles, by name.

Modules of this package register their queries by the decorator ``query``; ``load`` imports
them all.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "k2_concern_triage"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) -> DataFrame under its own name, with its oracle."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def load() -> None:
    package = importlib.import_module(__package__)
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{__package__}.{module.name}")
