"""Classifier over event and network features: encode, train, score, explain, keep."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.numbers import rounded
from ..operators.geo import ip_number
from ..operators.network import NETWORK_FEATURES
from .frames import CATEGORICAL, NUMERIC

INDEXED = [c for c in CATEGORICAL if c != "source_ip"]
FEATURES = NUMERIC + NETWORK_FEATURES + ["source_ip_no"] + [f"{c}_ix" for c in INDEXED]


def prepared(frame: DataFrame) -> DataFrame:
    """Numeric columns only doubles; the address becomes its number.

    An index of addresses would gather all of them on the driver; a tree splits
    on order, which the number has as well. The other categories are few.
    """
    number = F.coalesce(ip_number(F.col("source_ip")), F.lit(-1)).cast("double")
    return frame.withColumn("source_ip_no", number).withColumns({c: F.col(c).cast("double") for c in NUMERIC + NETWORK_FEATURES})


def encoder_stages() -> list:
    return [
        StringIndexer(inputCols=INDEXED, outputCols=[f"{c}_ix" for c in INDEXED], stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=FEATURES, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def encode_scale(frame: DataFrame) -> tuple[PipelineModel, DataFrame]:
    rows = prepared(frame)
    model = Pipeline(stages=encoder_stages()).fit(rows)
    return model, model.transform(rows)


def train_forest(frame: DataFrame, trees: int = 100, seed: int = 42, least: int = 50) -> PipelineModel:
    """Random forest of depth 10; refuses fewer than ``least`` rows or a single class.

    Fitting passes over the frame many times: give it a written table, not a long plan. The encoded rows are kept while the forest
    counts, samples and bins them, so that each is encoded once.
    """
    size = frame.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if size["n"] < least or size["k"] < 2:
        raise ValueError(f"not enough data to train: {size['n']} rows, {size['k']} classes")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=10, minInstancesPerNode=2, seed=seed,
        predictionCol="y_pred", probabilityCol="probability",
    )
    rows = prepared(frame)
    encoder = Pipeline(stages=encoder_stages()).fit(rows)
    encoded = encoder.transform(rows).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([*encoder.stages, forest.fit(encoded)])
    finally:
        encoded.unpersist()


def score_events(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Class and probability per event; MEDIUM from 0.8 and HIGH from 0.9 when malicious."""
    out = model.transform(prepared(frame)).withColumn("confidence", vector_to_array("probability")[1])
    bad = F.col("y_pred") == 1
    alert = F.when(bad & (F.col("confidence") >= 0.9), "HIGH").when(bad & (F.col("confidence") >= 0.8), "MEDIUM")
    return out.withColumn("is_suspicious", bad).withColumn("alert_severity", alert)


def importances(model: PipelineModel, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Features by importance, highest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(FEATURES, map(float, weights)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(rows)], "rank int, feature string, importance double")


def feature_text(feature: str, value: Column) -> Column:
    """Readable line for one feature and value."""
    shown = value.cast("bigint").cast("string")
    if feature in fixed.FEATURE_FLAGS:
        yes, no = fixed.FEATURE_FLAGS[feature]
        return F.when(value == 1, yes).otherwise(no)
    template = fixed.FEATURE_TEXTS.get(feature, feature + ": {v}")
    head, tail = template.split("{v}")
    return F.concat(F.lit(head), shown, F.lit(tail))


def explain_rows(model: PipelineModel, frame: DataFrame, top: int = 5) -> DataFrame:
    """Each row's values of the most important features; the few names become columns of the plan."""
    weights = model.stages[-1].featureImportances.toArray()
    best = sorted(zip(FEATURES, map(float, weights)), key=lambda r: (-r[1], r[0]))[:top]
    indexed = model.transform(prepared(frame))
    items = F.array(*[
        F.struct(
            F.lit(i + 1).alias("rank"), F.lit(f).alias("feature"), rounded(F.lit(w * 100), 1).alias("importance"),
            F.col(f).alias("value"), feature_text(f, F.col(f)).alias("description"),
        )
        for i, (f, w) in enumerate(best)
    ])
    return indexed.select("id", F.explode(items).alias("x")).select("id", "x.*")


def save_model(model: PipelineModel, path: str, spark: SparkSession, version: str, trained_at: datetime) -> None:
    """Model and a one-line description next to it."""
    model.write().overwrite().save(f"{path}/model")
    about = {
        "model_version": version, "trained_at": trained_at.isoformat(), "features_count": len(FEATURES),
        "model_type": "Random Forest Classifier", "n_estimators": model.stages[-1].getNumTrees,
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, DataFrame]:
    about = spark.read.schema(
        "model_version string, trained_at string, features_count int, model_type string, n_estimators int"
    ).json(f"{path}/about")
    return PipelineModel.load(f"{path}/model"), about
