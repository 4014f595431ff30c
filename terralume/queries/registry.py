"""Binds operator ids, a Spark callable and its oracle SQL under one name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: QueryFn
    sql: str | None
    bench: bool


_QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, bench: bool = False):
    """Register the decorated function under its own name."""

    def bind(run: QueryFn) -> QueryFn:
        name = run.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(name, tuple(ids.split()), run, sql, bench)
        return run

    return bind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered() -> dict[str, Query]:
    return dict(_QUERIES)
