"""Where the checked queries are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.normalize import normalize_products
from larder.plans.joins import evenly
from larder.session import cut_lineage
from larder.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id, with its SQL if it has one."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def products(spark: SparkSession, folder: str) -> DataFrame:
    """The normalised catalog."""
    return normalize_products(fixtures.catalog(spark, folder))


def stored_products(spark: SparkSession, folder: str) -> DataFrame:
    """The normalised catalog written once, for jobs that read it several times."""
    return cut_lineage(evenly(products(spark, folder), "code"))


def listed(items: Column | str, name: str) -> Column:
    """A list as one text, for comparing."""
    return F.array_join(items, "|").alias(name)


def rounded(value: Column | str, name: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6).alias(name or value)


def whole(value: Column | str, name: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("bigint").alias(name or value)
