"""Ordered analytics per key that stay parallel when one key holds most rows.

A window partitioned by the key alone puts a hot key into one task. Here rows
are partitioned by (key, time bucket). What crosses a bucket border is carried
by a summary with one row per key and non-empty bucket, whose size is bounded
by the calendar, not by the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import micros

MINUTE = 60_000_000
#: Rows (three narrow columns each) that a task sorts at once.
TASK_ROWS = 500_000


def spread(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``n`` rows by ``by`` in as many parts as keep a task's sort small, whatever the size of the input; small ones as Spark sees fit."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-n // TASK_ROWS)
    return rows.repartition(parts, *by) if parts > usual else rows


def with_previous(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], out: str = "prev_us", width_us: int = MINUTE
) -> DataFrame:
    """Add ``_us`` and the time of the key's previous row (``out``, in microseconds, null for the first)."""
    rows = df.withColumn("_us", micros(ts)).withColumn("_b", F.floor(F.col("_us") / width_us))
    inside = Window.partitionBy(*keys, "_b").orderBy("_us", *tie)
    rows = rows.withColumn("_p", F.lag("_us").over(inside))
    across = Window.partitionBy(*keys).orderBy("_b")
    carry = (
        df.withColumn("_us", micros(ts))
        .groupBy(*keys, F.floor(F.col("_us") / width_us).alias("_b"))
        .agg(F.max("_us").alias("_last"))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"),
                F.lag("_last").over(across).alias("_carry"))
    )
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_b") == F.col("_kb"),
    )
    return (
        rows.join(carry, cond, "left")
        .withColumn(out, F.coalesce("_p", "_carry"))
        .drop("_p", "_carry", "_b", "_kb", *[f"_k_{k}" for k in keys])
    )


def gap_moments(df: DataFrame, keys: list[str], ts: str, width_us: int = MINUTE) -> DataFrame:
    """Per key ``n`` rows, ``first_seen``, ``last_seen``, ``gaps``, and ``mean`` and ``squares`` (mean of squares) of the gaps in seconds.

    Rows are read and moved once. Gaps inside a (key, time bucket) are summed there; between buckets only the last time of the
    bucket before matters, so the key as a whole is a row per non-empty bucket. Rows are counted before, so that no task sorts
    more of a larger input.
    """
    n = df.count()
    rows = spread(df.select(*keys, micros(ts).alias("_us")).withColumn("_b", F.floor(F.col("_us") / width_us)), n, *keys, "_b")
    inside = Window.partitionBy(*keys, "_b").orderBy("_us")
    own = rows.withColumn("_gap", (F.col("_us") - F.lag("_us").over(inside)) / 1e6).groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.min("_us").alias("_first"), F.max("_us").alias("_last"),
        F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0)).alias("_squares"))
    across = Window.partitionBy(*keys).orderBy("_b")
    between = (F.col("_first") - F.lag("_last").over(across)) / 1e6
    total = spread(own, n, *keys).withColumn("_between", between).groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.sum(F.col("_squares") + F.coalesce(F.col("_between") * F.col("_between"), F.lit(0.0))).alias("_squares"))
    gaps = F.col("n") - 1
    return total.select(
        *keys, "n", F.timestamp_micros("_first").cast("timestamp_ntz").alias("first_seen"),
        F.timestamp_micros("_last").cast("timestamp_ntz").alias("last_seen"), gaps.alias("gaps"),
        F.when(gaps > 0, (F.col("_last") - F.col("_first")) / 1e6 / gaps).alias("mean"),
        F.when(gaps > 0, F.col("_squares") / gaps).alias("squares"))


def trailing_count(
    df: DataFrame, keys: list[str], ts: str, span_us: int, out: str, counted: Column | None = None
) -> DataFrame:
    """Rows of the key in ``(t - span, t]``, ties included; only ``counted`` ones count, all are returned.

    Each row becomes +1 at its own time, +1 at the start of the next bucket and
    -1 when it leaves the span; buckets are as long as the span, so a running
    sum inside (key, bucket) is the count. One shuffle, linear in the rows.
    """
    us = micros(ts)
    bucket = F.floor(us / span_us)
    payload = F.struct(*[F.col(c) for c in df.columns])
    empty = F.lit(None).cast(df.select(payload.alias("p")).schema["p"].dataType)
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    own = F.struct(bucket.alias("b"), us.alias("at"), one.alias("v"), payload.alias("row"))
    marks = F.array(
        own,
        F.struct((bucket + 1).alias("b"), ((bucket + 1) * span_us).alias("at"), F.lit(1).alias("v"), empty.alias("row")),
        F.struct((bucket + 1).alias("b"), (us + span_us).alias("at"), F.lit(-1).alias("v"), empty.alias("row")),
    )
    if counted is not None:
        marks = F.when(counted, marks).otherwise(F.array(own))
    key_cols = [F.col(k).alias(f"_k_{k}") for k in keys]
    exploded = df.select(*key_cols, F.explode(marks).alias("m")).select(*[f"_k_{k}" for k in keys], "m.*")
    running = (
        Window.partitionBy(*[f"_k_{k}" for k in keys], "b")
        .orderBy("at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        exploded.withColumn(out, F.sum("v").over(running))
        .filter(F.col("row").isNotNull())
        .select("row.*", out)
    )


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str, n: int, rank: str = "rn") -> DataFrame:
    """Newest ``n`` rows per key; Spark cuts each map partition to ``n`` rows per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)
