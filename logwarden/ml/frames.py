"""Labelled feature frames and an exact, repeatable split."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..operators.events import in_window, label_events
from ..operators.network import NETWORK_FEATURES, REAL_FEATURES
from ..operators.scoring import event_features

CATEGORICAL = ["attack_vector", "event_type", "source_ip", "request_method", "country"]
NUMERIC = [
    "hour", "day_of_week", "is_weekend", "is_night", "severity_level", "path_length", "has_query_string",
    "suspicious_chars", "ua_length", "is_bot",
]


def with_network(features: DataFrame, network: DataFrame) -> DataFrame:
    """Join the 18 network features of the source; one join, zero where unknown."""
    out = features.join(network.withColumnRenamed("ip", "source_ip"), "source_ip", "left")
    return out.fillna({c: 0.0 if c in REAL_FEATURES else 0 for c in NETWORK_FEATURES})


def training_frame(events: DataFrame, network: DataFrame, blocked: DataFrame, as_of: datetime) -> DataFrame:
    labels = label_events(events, blocked, as_of).select("id", "label")
    return with_network(event_features(events), network).join(labels, "id")


def validation_frame(events: DataFrame, network: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Events of 30 days, labelled by severity, block flag, type list or vector list."""
    rows = in_window(events, as_of, days * 24)
    bad = (
        F.col("severity").isin("critical", "high") | F.coalesce("is_blocked", F.lit(False))
        | F.col("event_type").isin(fixed.LABEL_TYPES) | F.coalesce(F.col("attack_vector").isin(fixed.LABEL_VECTORS), F.lit(False))
    )
    labels = rows.select("id", F.when(bad, 1).otherwise(0).alias("label"))
    return with_network(event_features(rows), network).join(labels, "id")


def stratified_split(rows: DataFrame, label: str, key: str, share: float, bits: int = 4) -> DataFrame:
    """Mark exactly floor(share * n) rows per label as train, the first by md5 of the key.

    Ranking a whole label would be one task per label. Instead rows are counted
    per hash prefix (at most 16^bits per label); the prefix holding the cut is
    the only one whose rows are ranked.
    """
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_p", F.substring("_h", 1, bits))
    sizes = hashed.groupBy(label, "_p").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(label).orderBy("_p")
    plan = sizes.select(
        F.col(label).alias("_l"), F.col("_p").alias("_q"),
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(Window.partitionBy(label)) * share).alias("_cut"), "_n",
    )
    placed = hashed.join(plan, (F.col(label) == F.col("_l")) & (F.col("_p") == F.col("_q")))
    inside = Window.partitionBy(label, "_p").orderBy("_h", key)
    whole = F.col("_before") + F.col("_n") <= F.col("_cut")
    none = F.col("_before") >= F.col("_cut")
    ranked = placed.withColumn("_r", F.row_number().over(inside))
    part = F.when(whole, "train").when(none, "test").when(F.col("_before") + F.col("_r") <= F.col("_cut"), "train").otherwise("test")
    return ranked.withColumn("part", part).drop("_h", "_p", "_l", "_q", "_before", "_cut", "_n", "_r")
