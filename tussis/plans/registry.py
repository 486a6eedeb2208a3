"""Query registry: a Spark plan per name and, where one exists, its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tussis.operators.sizing import spread
from tussis.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` with its SQL twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: a file too small to fill the cores is spread over them."""
    return spread(table(spark, folder, name))


def sql_text(value: str) -> str:
    """A quoted SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_strip(expression: str) -> str:
    """SQL for text without white space of any kind at either end."""
    space = r"[\t-\r \x1c-\x1f\x85\p{Z}]+"
    return f"regexp_replace({expression}, '^{space}|{space}$', '', 'g')"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"
