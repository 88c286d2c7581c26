"""Where queries and the DuckDB SQL of the same results are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import dsl
from larkspur.plans.sqlfront import Engine
from larkspur.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, run: Callable, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise KeyError(name)
    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


def sql(name: str, text: str, *tables: str, oracle: str | None = None) -> None:
    """A query in the engine's SQL; the oracle is the same text unless given."""
    add(name, lambda spark, sf_dir: Engine(spark).over(sf_dir, *tables).sql(text), oracle or text)


def query(name: str, build: Callable[..., dict], *tables: str, oracle: str | None = None) -> None:
    """A query as a dict, built from its tables."""
    add(name, lambda spark, sf_dir: dsl.q(build(*[table(spark, sf_dir, t) for t in tables])), oracle)


def frame(name: str, build: Callable[..., DataFrame], *tables: str, oracle: str | None = None) -> None:
    """A query built from DataFrames."""
    add(name, lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables]), oracle)
