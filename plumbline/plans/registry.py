"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.feeds import Data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Data], DataFrame]], Callable[[Data], DataFrame]]:
    """Register ``fn(data)`` under ``name`` with its SQL twin."""

    def register(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
