"""Queries over the given tables, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Check] = {}


def check(sql: str | None = None):
    """Register the decorated function under its name."""

    def add(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {fn.__name__}")
        REGISTRY[fn.__name__] = Check(fn, sql)
        return fn

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> dict[str, Check]:
    from checks import cells, compare, files, grids, jsoncells, links, pages, registries, streams, urlcells, versions  # noqa: F401

    return REGISTRY
