"""Queries that train and use models. A trained forest is kept per session and data folder."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..ml import frames, isolation, models
from ..operators import metrics as mx, scoring as sc
from ..session import shared_dir
from .network_queries import FEATS, features
from .registry import query
from .views import AS_OF

_MODELS: dict[tuple, object] = {}


def known(t, purpose: str) -> tuple:
    """Names what is kept by session, folder and a fingerprint of its events, so that changed data are read anew."""
    seen = t.events.agg(F.count("*"), F.bit_xor(F.xxhash64("event_id", "ts", "user_id", "event_type", "value"))).first()
    return t.spark.sparkContext.applicationId, t.dir, purpose, *seen


def saved(t, purpose, build):
    """A frame written once to the shared folder, because training passes over it many times."""
    key = known(t, purpose)
    if key not in _MODELS:
        path = shared_dir(t.spark, purpose)
        build().write.parquet(path)
        _MODELS[key] = path
    return t.spark.read.parquet(_MODELS[key])


def labelled(t):
    return saved(t, "frame", lambda: frames.stratified_split(
        frames.training_frame(t.full_events, features(t), t.blocked_ips, AS_OF), "label", "id", 0.8))


def forest(t):
    key = known(t, "forest")
    if key not in _MODELS:
        _MODELS[key] = models.train_forest(labelled(t).filter("part = 'train'"))
    return _MODELS[key]


@query("encode_scale", f"""
with {FEATS}, b as (select e.id, cast(hour(timestamp) as double) as hour, cast(length(request_path) as double) as path_length, cast(coalesce(f.http_requests, 0) as double) as http_requests,
  cast(dense_rank() over (order by event_type) - 1 as double) as event_type_ix from full_events e left join feats f on e.source_ip = f.ip)
select id, """ + ", ".join(f"round_even(coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0), 6) as {c}" for c in ("hour", "path_length", "http_requests", "event_type_ix")) + " from b")
def _(t):
    _, rows = models.encode_scale(labelled(t))
    arr = vector_to_array("features")
    return rows.select("id", *[rounded(arr[models.FEATURES.index(c)], 6).alias(c) for c in ("hour", "path_length", "http_requests", "event_type_ix")])


@query("train_forest")
def _(t):
    test = models.score_events(forest(t), labelled(t).filter("part = 'test'"))
    return mx.classification_metrics(test.select(F.col("label").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")))


def odd_forest(t):
    key = known(t, "isolation")
    if key not in _MODELS:
        rows = models.score_events(forest(t), labelled(t)).withColumn("x", vector_to_array("features"))
        _MODELS[key] = isolation.fit(rows.filter("part = 'train'").select("id", "x"))
    return _MODELS[key]


def flagged(rows, model, odd):
    """``rows`` with class, probability and anomaly flag."""
    return isolation.flag_anomalies(isolation.with_scores(models.score_events(model, rows).withColumn("x", vector_to_array("features")), odd), odd)


def scored(t):
    """Class, probability and anomaly flag of every event."""
    return flagged(labelled(t), forest(t), odd_forest(t))


@query("score_events")
def _(t):
    rows = scored(t)
    reason = sc.prediction_reason(F.col("is_suspicious"), F.col("confidence"), F.col("is_anomaly"))
    return rows.select("id", "source_ip", "is_suspicious", "confidence", "is_anomaly", "alert_severity", reason.alias("reason"))


@query("anomaly_forest")
def _(t):
    return scored(t).select("id", "anomaly_score", "is_anomaly")


@query("feature_importance")
def _(t):
    return models.importances(forest(t), t.spark, 20)


@query("row_explanation")
def _(t):
    return models.explain_rows(forest(t), labelled(t))


def agreement(rows, classes: int):
    """Pairs of rows of one id, and in how many of them classes (``again``, ``y_pred``) and flags (``flag_again``, ``is_anomaly``) are the same.

    An id has one row unless the events repeat it. The pairs of an id follow from its counts, so rows scored by both models side by side need no join.
    """
    def pairs(left, right, values):
        return reduce(add, [F.count_if(F.col(left) == v) * F.count_if(F.col(right) == v) for v in values])

    per_id = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(
        (F.count("*") * F.count("*")).alias("rows"), pairs("again", "y_pred", map(F.lit, range(classes))).alias("equal"),
        pairs("flag_again", "is_anomaly", (F.lit(True), F.lit(False))).alias("equal_flags"))
    return per_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "equal", "equal_flags")])


@query("save_load_model")
def _(t):
    path, rows, model, odd = shared_dir(t.spark, "model"), labelled(t), forest(t), odd_forest(t)
    models.save_model(model, path, t.spark, "v1.0.0", AS_OF)
    loaded, about = models.load_model(path, t.spark)
    isolation.save(odd, f"{path}/isolation", t.spark)
    again = flagged(rows, loaded, isolation.load(f"{path}/isolation", t.spark)).select(
        *rows.columns, F.col("y_pred").alias("again"), F.col("is_anomaly").alias("flag_again"))
    both = flagged(again, model, odd).select("id", "again", "y_pred", "flag_again", "is_anomaly")
    from ..operators.events import one_row

    return one_row(about, agreement(both, model.stages[-1].numClasses))


@query("store_metrics", """
with cm as (select model_version, count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn, count(*) filter (where y_true = 1 and y_pred = 1) as tp from scored group by 1)
select model_version, tn + fp + fn + tp as samples, (tp + tn) / (tn + fp + fn + tp) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_score, timestamp '2024-01-31 00:00:00' as evaluated_at from cm""")
def _(t):
    from ..functions.times import ts_lit

    path = shared_dir(t.spark, "model-metrics")
    history = mx.classification_metrics(t.scored, ["model_version"]).withColumn("evaluated_at", ts_lit(AS_OF))
    history.write.mode("append").parquet(path)
    return t.spark.read.parquet(path)
