"""Small helpers on DataFrames shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: A table of at most so many rows, each of a few numbers, may be sent to all executors.
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_k`` that no column of ``df`` has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out, k = name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that lost executors cost no recomputation."""
    spark: SparkSession = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``limit`` narrow rows; else it is shuffled as any other."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_key(text: Column) -> Column:
    """A digest that stands for a whole text in joins; nulls have one of their own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))
