"""Invariants of the model operators."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from logwarden.ml import frames, isolation, models
from logwarden.operators import metrics as mx
from logwarden.plans import ml_queries as mq
from logwarden.plans.registry import QUERIES
from logwarden.plans.views import AS_OF


@pytest.fixture(scope="module")
def labelled(tables):
    return mq.labelled(tables)


@pytest.fixture(scope="module")
def model(labelled):
    return models.train_forest(labelled.filter("part = 'train'"), trees=20)


def test_auc_equals_mllib(tables):
    scored = tables.scored.select(F.col("y_true").cast("double").alias("label"), F.col("y_prob").alias("rawPrediction"), "y_true", "y_prob")
    ours = mx.roc_auc(scored).first()["auc"]
    theirs = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(scored)
    assert abs(ours - theirs) < 1e-6


def test_confusion_counts_sum_to_rows(tables):
    row = mx.confusion_matrix(tables.scored).first()
    assert row.tn + row.fp + row.fn + row.tp == tables.scored.count()


def test_zero_division_gives_zero(spark):
    row = mx.classification_metrics(spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_curve_ends(tables):
    points = {(r.fpr, r.tpr) for r in mx.roc_curve(tables.scored).collect()}
    assert (0.0, 0.0) in points
    assert any(r.precision == 1.0 and r.recall == 0.0 for r in mx.pr_curve(tables.scored).collect()) or mx.pr_curve(tables.scored).count() >= 100


def test_split_is_exact_and_repeatable(tables):
    rows = tables.security_events.select("id", (F.col("severity") == "high").cast("int").alias("label"))
    first = frames.stratified_split(rows, "label", "id", 0.8)
    again = {r.id: r.part for r in frames.stratified_split(rows.repartition(3), "label", "id", 0.8).collect()}
    assert {r.id: r.part for r in first.collect()} == again
    for r in first.groupBy("label").agg(F.count_if(F.col("part") == "train").alias("a"), F.count("*").alias("n")).collect():
        assert r.a == int(r.n * 0.8)


def test_forest_learns_and_scores(labelled, model):
    out = models.score_events(model, labelled)
    assert out.count() == labelled.count()
    m = mx.classification_metrics(out.select(F.col("label").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"))).first()
    assert m.accuracy > 0.8
    assert out.filter("alert_severity = 'HIGH' and confidence < 0.9").count() == 0


def test_training_refuses_little_data(labelled):
    with pytest.raises(ValueError):
        models.train_forest(labelled.limit(10))
    with pytest.raises(ValueError):
        models.train_forest(labelled.filter("label = 1"))


def test_training_encodes_each_row_once(spark, labelled):
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        read.add(1)
        return x

    rows = labelled.filter("part = 'train'").persist()
    n = rows.count()
    models.train_forest(rows.withColumn("hour", counted("hour")), trees=2)
    assert n <= read.value <= 2 * n  # once for the scaler's means, once for the forest
    rows.unpersist()


def test_isolation_scores_equal_a_walk_from_the_root(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)), 1)
    trees = []
    for k in range(7):
        f, cut, left, right, depth = (list(c) for c in zip(*isolation.grow(x[rng.choice(300, 64)], rng)))
        trees.append({"tree": k, "n": 64, "f": f, "cut": cut, "l": left, "r": right, "d": depth})
    x[5, 1] = np.nan
    forest = isolation.Forest(trees, 1.0)
    assert all(walk.shape == (2 * len(t["f"]),) for t, (_, _, walk, _, _) in zip(trees, map(isolation.walkable, trees)))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    got = {r.id: r.anomaly_score for r in isolation.with_scores(rows, forest).collect()}
    for i, r in enumerate(x):
        total = 0.0
        for t in trees:
            node = 0
            while t["f"][node] >= 0:
                node = t["l"][node] if r[t["f"][node]] <= t["cut"][node] else t["r"][node]
            total += t["d"][node]
        assert abs(got[i] - 2.0 ** (-total / 7 / isolation.mean_depth(64))) < 1e-12


def test_importances_sum_to_one(spark, model):
    total = models.importances(model, spark).agg(F.sum("importance")).first()[0]
    assert abs(total - 1) < 1e-6


def test_unseen_category_is_scored(labelled, model):
    odd = labelled.limit(5).withColumn("event_type", F.lit("never seen"))
    assert models.score_events(model, odd).filter("confidence is not null").count() == 5


def test_isolation_forest_finds_far_points(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 20, F.array(F.lit(50.0) + F.rand(1), F.lit(-40.0))).otherwise(
        F.array(F.randn(2), F.randn(3))).alias("x"))
    path_free = rows.cache()
    forest = isolation.fit(path_free, trees=50)
    flagged = isolation.flag_anomalies(isolation.with_scores(path_free, forest), forest)
    far = flagged.filter("id < 20").agg(F.min("anomaly_score").alias("a")).first().a
    near = flagged.filter("id >= 20").agg(F.avg("anomaly_score").alias("a")).first().a
    assert far > near + 0.15
    assert flagged.filter("id < 20 and not is_anomaly").count() == 0
    assert 0.05 < flagged.filter("is_anomaly").count() / 2000 < 0.15
    good = flagged.filter("not is_anomaly").limit(10).drop("anomaly_score", "is_anomaly")
    assert isolation.flag_anomalies(isolation.with_scores(good, forest), forest).filter("is_anomaly").count() == 0


def test_isolation_forest_survives_saving(spark, tmp_path):
    rows = spark.range(500).select("id", F.array(F.randn(2), F.randn(3)).alias("x")).cache()
    forest = isolation.fit(rows, trees=5)
    isolation.save(forest, f"{tmp_path}/odd", spark)
    again = isolation.load(f"{tmp_path}/odd", spark)
    flags = [sorted(map(tuple, isolation.flag_anomalies(isolation.with_scores(rows, f), f).select("id", "is_anomaly").collect())) for f in (forest, again)]
    assert again.cut == forest.cut and flags[0] == flags[1]


def test_model_survives_saving(spark, labelled, model, tmp_path):
    models.save_model(model, str(tmp_path), spark, "v9", AS_OF)
    loaded, about = models.load_model(str(tmp_path), spark)
    assert about.first().model_version == "v9" and about.first().features_count == len(models.FEATURES)
    a = {r.id: r.confidence for r in models.score_events(model, labelled).collect()}
    b = {r.id: r.confidence for r in models.score_events(loaded, labelled).collect()}
    assert a == b


def test_agreement_counts_the_pairs_of_an_id(spark):
    rng = np.random.default_rng(8)
    data = [(None if k % 7 == 0 else int(rng.integers(0, 60)), float(rng.integers(3)), float(rng.integers(3)),
             None if k % 11 == 0 else bool(rng.integers(2)), bool(rng.integers(2))) for k in range(200)]
    rows = spark.createDataFrame(data, "id long, again double, y_pred double, flag_again boolean, is_anomaly boolean")
    pairs = [(a, b) for a in data for b in data if a[0] is not None and a[0] == b[0]]
    want = (len(pairs), sum(a[1] == b[2] for a, b in pairs), sum(a[3] == b[4] for a, b in pairs))
    assert tuple(mq.agreement(rows, 3).first()) == want and tuple(mq.agreement(rows.limit(0), 3).first()) == (0, 0, 0)


def test_saved_model_is_compared_side_by_side(tables, labelled, model, monkeypatch):
    odd = isolation.fit(models.score_events(model, labelled).withColumn("x", mq.vector_to_array("features")).select("id", "x"), trees=3)
    monkeypatch.setitem(mq._MODELS, mq.known(tables, "forest"), model)
    monkeypatch.setitem(mq._MODELS, mq.known(tables, "isolation"), odd)
    scored, score = [], models.score_events
    monkeypatch.setattr(models, "score_events", lambda m, rows: scored.append(m) or score(m, rows))
    got = QUERIES["save_load_model"](tables.spark, tables.dir)
    n = labelled.count()
    row = got.first()
    assert (row.rows, row.equal, row.equal_flags) == (n, n, n) and len(scored) == 2 and scored[0] is not scored[1]
    assert "(id#" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_curve_parts_are_even_where_scores_pile_up(spark):
    rng = np.random.default_rng(5)
    piled = np.concatenate([np.zeros(3000), np.ones(3000), 0.5 + rng.integers(0, 4000, 9000) * 1e-9, rng.random(100)])
    rows = [(float(p), int(y)) for p, y in zip(piled, rng.integers(0, 2, len(piled)))] + [(None, 1)]
    scored = spark.createDataFrame(rows, "y_prob double, y_true int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in mx.score_parts(scored).groupBy("b").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = {r.threshold: (r.tps, r.fps, r.pos_no) for r in mx.cumulative_counts(scored).collect()}
    tps = fps = 0
    for k, p in enumerate(sorted(set(piled.tolist()), reverse=True), 1):
        own = [y for q, y in rows if q == p]
        tps, fps = tps + sum(own), fps + len(own) - sum(own)
        assert got[p] == (tps, fps, k)
    assert len(got) == len(set(piled)) and mx.cumulative_counts(scored.limit(0)).count() == 0
