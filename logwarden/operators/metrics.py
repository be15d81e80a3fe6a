"""Classifier quality: metrics, confusion counts, ROC and precision-recall curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import rounded
from ..functions import text
from ..session import shared_table


def confusion_counts(y: str = "y_true", p: str = "y_pred") -> dict[str, Column]:
    t, g = F.col(y), F.col(p)
    return {
        "tn": F.count_if((t == 0) & (g == 0)), "fp": F.count_if((t == 0) & (g == 1)),
        "fn": F.count_if((t == 1) & (g == 0)), "tp": F.count_if((t == 1) & (g == 1)),
    }


def confusion_matrix(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in confusion_counts().items()])


def classification_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    m = confusion_matrix(scored, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return m.select(
        *(by or []),
        (tn + fp + fn + tp).alias("samples"),
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def score_parts(scored: DataFrame, score: str = "y_prob", label: str = "y_true") -> DataFrame:
    """Positives and negatives per distinct score, with its part ``b``: ranges of scores, highest first, cut at quantiles Spark samples.

    However scores are piled up, parts have about equally many distinct ones. The table is written, as a second sample could cut elsewhere.
    """
    per = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return shared_table(per.repartitionByRange(F.desc("threshold")).withColumn("b", F.spark_partition_id()), "scores")


def cumulative_counts(scored: DataFrame, score: str = "y_prob", label: str = "y_true") -> DataFrame:
    """Per distinct score, highest first: running positives and negatives and position; a written table.

    Rows are first counted per score, then summed inside ranges of scores and across the totals of the ranges, so no task
    orders the whole data. Rows without a score do not count.
    """
    per = score_parts(scored, score, label)
    inside = Window.partitionBy("b").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count("*").alias("k"))
    carry = totals.select("b", *[F.coalesce(F.sum(c).over(across), F.lit(0)).alias("c" + c) for c in ("p", "n", "k")])
    rows = per.select("*", F.sum("pos").over(inside).alias("ip"), F.sum("neg").over(inside).alias("in"), F.row_number().over(inside).alias("ik"))
    return shared_table(rows.join(carry, "b").select(
        "threshold", "pos", "neg", (F.col("ip") + F.col("cp")).alias("tps"), (F.col("in") + F.col("cn")).alias("fps"),
        (F.col("ik") + F.col("ck")).cast("bigint").alias("pos_no"),
    ), "curve")


def label_totals(scored: DataFrame, label: str = "y_true") -> DataFrame:
    return scored.agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) == 0).alias("N"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids; ties share one step."""
    c = cumulative_counts(scored)
    area = F.sum(F.col("neg").cast("double") * (F.col("tps") + F.col("tps") - F.col("pos")) / 2)
    out = c.agg(area.alias("a"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return out.select(F.coalesce(F.try_divide(F.col("a"), F.col("P").cast("double") * F.col("N")), F.lit(0.5)).alias("auc"))


def thin(points: DataFrame, index: str, most: int = 100) -> DataFrame:
    """Every step-th point so that about ``most`` remain; ``index`` counts from 0."""
    n = points.agg((F.max(index) + 1).alias("n")).select(F.greatest(F.lit(1), F.floor(F.col("n") / most)).cast("bigint").alias("step"))
    return points.withColumn("_step", n.scalar()).filter(F.col(index) % F.col("_step") == 0).drop("_step")


def roc_curve(scored: DataFrame) -> DataFrame:
    """Curve points (threshold, fpr, tpr) without collinear ones, thinned to about 100.

    The start point has threshold 1.
    """
    c = cumulative_counts(scored)
    nxt = c.select((F.col("pos_no") - 1).alias("pos_no"), F.col("pos").alias("np"), F.col("neg").alias("nn"))
    corner = (
        (F.col("pos_no") == 1) | F.col("np").isNull() | (F.col("np") != F.col("pos")) | (F.col("nn") != F.col("neg"))
    )
    kept = c.join(nxt, "pos_no", "left").filter(corner)
    start = c.sparkSession.range(1).select(
        F.lit(1.0).alias("threshold"), F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"), F.lit(0).cast("bigint").alias("pos_no")
    )
    points = start.unionByName(kept.select("threshold", "tps", "fps", "pos_no"))
    numbered = renumber(points, "pos_no")
    total = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    p, n = total.select("P").scalar(), total.select("N").scalar()
    return thin(numbered, "i").select(
        "threshold",
        F.coalesce(F.try_divide(F.col("fps").cast("double"), n.cast("double")), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide(F.col("tps").cast("double"), p.cast("double")), F.lit(0.0)).alias("tpr"),
    )


def renumber(points: DataFrame, order: str, width: int = 4096) -> DataFrame:
    """Dense index ``i`` from 0 in the order of an integer column, without a global sort."""
    rows = points.withColumn("_b", F.floor(F.col(order) / width))
    carry = rows.groupBy("_b").agg(F.count("*").alias("_k")).select(
        "_b", F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c")
    )
    inside = Window.partitionBy("_b").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(inside) - 1).join(carry, "_b").withColumn(
        "i", (F.col("_r") + F.col("_c")).cast("bigint")
    ).drop("_b", "_r", "_c")


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall per threshold, lowest first, ending in (1, 0); thinned to about 100."""
    c = cumulative_counts(scored)
    total = c.agg(F.sum("pos").alias("P"), F.max("pos_no").alias("K"))
    p, k = total.select("P").scalar(), total.select("K").scalar()
    points = c.select(
        (k - F.col("pos_no")).alias("i"), "threshold",
        (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("tps").cast("double"), p.cast("double")), F.lit(1.0)).alias("recall"),
    )
    last = c.agg(F.max("pos_no").alias("i")).select(
        "i", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return thin(points.unionByName(last), "i").drop("i")


def pr_auc(scored: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids over recall."""
    c = cumulative_counts(scored)
    tps, fps, pos, neg = (F.col(x) for x in ("tps", "fps", "pos", "neg"))
    before = tps + fps - pos - neg
    previous = F.when(before > 0, (tps - pos) / before).otherwise(F.lit(1.0))
    area = F.sum(pos.cast("double") * (tps / (tps + fps) + previous) / 2)
    return c.agg(area.alias("a"), F.sum("pos").alias("P")).select(
        F.coalesce(F.try_divide(F.col("a"), F.col("P").cast("double")), F.lit(0.5)).alias("auc")
    )


def latest_per_version(history: DataFrame) -> DataFrame:
    """Newest evaluation of each model version."""
    cols = history.columns
    return history.groupBy("model_version").agg(F.max_by(F.struct(*cols), F.struct("evaluated_at", "run")).alias("m")).select("m.*")


def compare_versions(history: DataFrame, first: str, second: str, measures: list[str]) -> DataFrame:
    """Two versions side by side, one row per measure, with the difference."""
    newest = latest_per_version(history.filter(F.col("model_version").isin(first, second)))
    long = newest.unpivot(["model_version"], measures, "measure", "value")
    side = long.groupBy("measure").agg(
        F.max(F.when(F.col("model_version") == first, F.col("value"))).alias("version1"),
        F.max(F.when(F.col("model_version") == second, F.col("value"))).alias("version2"),
    )
    return side.withColumn("difference", rounded(F.col("version2") - F.col("version1"), 6))


def metric_trend(recent: DataFrame, measure: str = "accuracy", gap: float = 0.01) -> DataFrame:
    """Newest evaluation against the one before; ``recent`` is a short, limited history."""
    two = recent.orderBy(F.desc("evaluated_at"), "model_version").limit(2)
    order = Window.orderBy(F.desc("evaluated_at"), "model_version")
    rows = two.withColumn("previous", F.lead(measure).over(order)).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    now, old = F.col(measure), F.col("previous")
    trend = text.first_case([(now > old + gap, "improving"), (now < old - gap, "degrading")], "stable")
    return rows.select("model_version", "evaluated_at", now.alias("latest"), "previous", trend.alias("trend"))
