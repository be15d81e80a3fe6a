"""Catalogue of runnable queries: key, Spark plan, equivalent check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Flat, engine-neutral output: arrays joined by ``|``, zone-less timestamps."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.when(c.isNotNull(), F.concat_ws("|", c.cast("array<string>")))
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: flat(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register
