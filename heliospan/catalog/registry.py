"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heliospan.catalog.oracle import with_ctes
from heliospan.standins import Tables

Build = Callable[[Tables], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; without SQL it is checked by tests on small fixtures."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return build

    return add


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Build) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}
