"""Table upkeep and exports: upserts, retention, counts, snapshots, CSV and JSON files."""

from __future__ import annotations

import re
from datetime import datetime, time as clock, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..functions.times import before, ts_lit
from ..session import shared_table

THREAT_COLUMNS = ["ip", "score", "ml_confidence", "zeek_detections", "fail2ban_bans", "total_events", "country", "last_seen"]
TIMELINE_COLUMNS = ["timestamp", "ml_detections", "zeek_detections", "fail2ban_bans", "total"]


def upsert_predictions(store: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """One row per address, the newest analysis; a new address without dates gets ``as_of``."""
    cols = ["ml_confidence", "threat_score", "total_events", "first_seen", "last_seen", "analyzed_at", "is_valid"]
    old = store.select("ip_address", *cols, F.lit(0).alias("fresh"))
    new = batch.withColumn("is_valid", F.lit(True)).select("ip_address", *cols, F.lit(1).alias("fresh"))
    last = old.unionByName(new).groupBy("ip_address").agg(
        F.max_by(F.struct(*cols), F.struct("analyzed_at", "fresh")).alias("r"), F.min("fresh").alias("only_new")
    )
    insert = F.col("only_new") == 1

    def date(c: str):
        return F.when(insert, F.coalesce(F.col(f"r.{c}"), ts_lit(as_of))).otherwise(F.col(f"r.{c}")).alias(c)

    return last.select(
        "ip_address", "r.ml_confidence", "r.threat_score", "r.total_events", date("first_seen"), date("last_seen"),
        "r.analyzed_at", "r.is_valid", (F.col("r.ml_confidence") >= 0.6).alias("is_suspicious"),
    )


def retained(table: DataFrame, time: str, as_of: datetime, days: int) -> DataFrame:
    return table.filter(F.col(time) >= before(as_of, days=days))


def retention_report(tables: dict[str, tuple[DataFrame, str]], as_of: datetime, days: int) -> DataFrame:
    """Per table (with its time column) the rows that a clean-up deletes and keeps; rows without a time are kept."""
    old = lambda time: F.coalesce(F.col(time) < before(as_of, days=days), F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count_if(old(time)).alias("deleted"), F.count_if(~old(time)).alias("kept")).select(F.lit(name).alias("table_name"), "deleted", "kept")
        for name, (df, time) in tables.items()])


def clean_up(table: DataFrame, time: str, as_of: datetime, days: int, path: str) -> DataFrame:
    """Write what is kept to ``path``, a folder other than the table's own, and return it as read from there."""
    old = F.coalesce(F.col(time) < before(as_of, days=days), F.lit(False))
    table.filter(~old).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


DAY = "_day"


def write_by_day(table: DataFrame, time: str, path: str) -> None:
    """Write ``table`` in a folder per day of ``time``; rows without a time have a folder of their own."""
    table.withColumn(DAY, F.col(time).cast("date")).write.partitionBy(DAY).parquet(path)


def clean_up_days(spark: SparkSession, path: str, schema: StructType, time: str, as_of: datetime, days: int) -> DataFrame:
    """Delete what is older than ``days`` in place from a table written by ``write_by_day`` and return the rest.

    Folders of earlier days go without being read; only the border day is read and written anew, unless the border is midnight.
    All other files stay as they are. Run again after a crash it ends the same: the rows of the border day are written aside first.
    """
    border = as_of - timedelta(days=days)
    folder = f"{path}/{DAY}={border:%Y-%m-%d}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {s.getPath().getName() for s in store.listStatus(root) if s.isDirectory()}
    dated = {n: n.removeprefix(f"{DAY}=") for n in names if re.fullmatch(rf"{DAY}=\d{{4,}}-\d\d-\d\d", n)}
    for name, day in dated.items():
        if day < f"{border:%Y-%m-%d}":
            store.delete(fs.Path(f"{path}/{name}"), True)
    if folder.rsplit("/", 1)[1] in dated and border.time() != clock(0):
        kept = shared_table(spark.read.schema(schema).parquet(folder).filter(F.col(time) >= ts_lit(border)), "border-day")
        if kept.isEmpty():
            store.delete(fs.Path(folder), True)
        else:
            one = kept.withColumn(DAY, F.lit(border.date()))
            one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return spark.read.schema(StructType([*schema.fields, StructField(DAY, DateType())])).parquet(path).drop(DAY)


def invalidated(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("is_valid", F.lit(False))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and in total; the counts are one row each before they meet."""
    counts = reduce(
        lambda a, b: a.unionByName(b),
        [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()],
    )
    return counts.rollup("table_name").agg(F.sum("n").alias("n")).select(F.coalesce("table_name", F.lit("total")).alias("table_name"), "n")


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export(df: DataFrame, path: str, fmt: str = "csv", columns: list[str] | None = None) -> None:
    """Write a report as CSV with header or as JSON lines."""
    out = df.select(*columns) if columns else df
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).option("timestampNTZFormat", MICROS).csv(path)
    elif fmt == "json":
        out.write.mode("overwrite").option("timestampNTZFormat", MICROS).json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def snapshot(tables: dict[str, DataFrame], path: str, as_of: datetime) -> DataFrame:
    """Write every table as parquet and a manifest with its row count; returns the manifest.

    Counts are taken from the written files, so the manifest tells what is there.
    """
    path = path.rstrip("/")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    written = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    manifest = row_counts(written).withColumn("export_date", ts_lit(as_of)).withColumn("tables_count", F.lit(len(tables)))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
