"""Registry of runnable queries and the statements that check them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estuarine.plans.views import Views, with_views

AREAS = (
    "diversity reads sources store similarity lineage vectors clustering assignment identity environment timing"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query over `Views`, with its checking SQL when one exists."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(tuple(uses.split()), sql)
        return fn

    return wrap


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"estuarine.queries.{area}")
