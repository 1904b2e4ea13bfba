"""G1-G3 on a small table with few rounds (the full 50 rounds run in the
registered queries)."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardflow.functions import trees
from wardflow.operators import model as M


def test_train_score_metrics(patients_small):
    m = M.train_risk_model(patients_small, max_iter=5)
    assert m.numFeatures == 15
    names = [n for n, _ in M.feature_importances(m)]
    assert names[:5] == ["age", "los", "cost_estimate", "cancel_risk", "priority_score"]
    assert "gender_M" in names and "specialty_Cardiology" not in names and "season_Autumn" not in names
    scored = M.score_patients(m, patients_small)
    assert {"prediction", "score", "percentage"} <= set(scored.columns)
    met = M.model_metrics(scored).first()
    assert met.train_auc > 0.9 and met.train_accuracy > 0.8 and met.training_rows == 1500


def test_auc_is_exact(spark):
    rows = [(0.1, 0, 0), (0.4, 1, 0), (0.35, 1, 1), (0.8, 1, 1), (0.4, 0, 1), (0.9, 1, 1)]
    df = spark.createDataFrame(rows, "score double, label int, prediction int")
    got = M.model_metrics(df).first().train_auc
    pos = [s for s, y, _ in rows if y == 1]
    neg = [s for s, y, _ in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_unknown_values_are_scored(spark, patients_small):
    m = M.train_risk_model(patients_small.filter("specialty != 'Cardiology'"), max_iter=2, max_training_rows=700)
    assert m.numFeatures == 15
    odd = patients_small.limit(3).withColumns({"specialty": F.lit("Dermatology"), "season": F.lit(None).cast("string")})
    rows = M.score_patients(m, odd).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.features[6:12] == [0.0] * 6 for r in M.feature_vectors(odd).collect())


def _with_scores_of(booster, df):
    return booster.transform(df).withColumn("ref", vector_to_array("probability")[1])


def test_expression_equals_the_fitted_model(patients_small):
    """On values: the expression; on bin numbers: the booster itself."""
    m = M.train_risk_model(patients_small, max_iter=12)
    binned = patients_small.withColumns(M.bin_numbers(m.cuts))
    ref = _with_scores_of(m.booster, M.with_features(binned)).select("patient_id", "ref", F.col("prediction").alias("p"))
    j = M.score_patients(m, patients_small).join(ref, "patient_id")
    worst = j.agg(F.max(F.abs(F.col("score") - F.col("ref"))).alias("d"),
                  F.max((F.col("prediction") != F.col("p")).cast("int")).alias("p"), F.count("*").alias("n")).first()
    assert worst.d < 1e-12 and worst.p == 0 and worst.n == 1500


def test_expression_of_a_plain_booster(patients_small):
    """A booster that was fitted on the features themselves."""
    from pyspark.ml.classification import GBTClassifier
    data = M.with_features(patients_small.withColumn("label", F.col("label").cast("double")))
    plain = GBTClassifier(labelCol="label", maxDepth=4, maxIter=6, seed=1).fit(data)
    ref = _with_scores_of(plain, M.with_features(patients_small)).select("patient_id", "ref")
    j = M.score_patients(plain, patients_small).join(ref, "patient_id")
    assert j.filter(F.abs(F.col("score") - F.col("ref")) > 1e-12).count() == 0 and j.count() == 1500


def test_scoring_plan_has_no_vectors(patients_small):
    m = M.train_risk_model(patients_small, max_iter=3)
    plan = M.score_patients(m, patients_small)._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan and "VectorAssembler" not in plan


def test_binned_training_is_as_good(patients_mid):
    """AUC over all patients within 0.001 of a fit on the unbinned rows."""
    from pyspark.ml.classification import GBTClassifier

    from wardflow import constants as K
    data = M.with_features(patients_mid.withColumn("label", F.col("label").cast("double")))
    plain = GBTClassifier(labelCol="label", maxDepth=K.MODEL_MAX_DEPTH, stepSize=K.MODEL_STEP_SIZE, maxIter=15,
                          subsamplingRate=K.MODEL_SUBSAMPLE, seed=K.MODEL_SEED).fit(data)
    auc = [M.model_metrics(M.score_patients(m, patients_mid)).first().train_auc
           for m in (plain, M.train_risk_model(patients_mid, max_iter=15))]
    assert auc[1] > auc[0] - 0.001


def test_cells_hold_every_patient(patients_mid):
    cells, cuts = M.training_cells(patients_mid, bins=4)
    rows = cells.collect()
    assert sum(r.weight for r in rows) == patients_mid.count()
    assert all(len(c) <= 3 for c in cuts.values())
    ages = sorted(r.age for r in patients_mid.select("age").collect())
    assert all(abs(ages.index(int(c)) / len(ages) - (i + 1) / 4) < 0.05 for i, c in enumerate(cuts["age"]))
    # More patients of the same values make no more cells.
    many = patients_mid
    for _ in range(3):
        many = many.unionByName(patients_mid)
    more, _ = M.training_cells(many, bins=4)
    assert more.agg(F.sum("weight")).first()[0] == 60_000 and more.count() < 1.1 * len(rows)


def test_rows_of_one_label_or_value(spark, patients_small):
    """Features without a cut, and labels without a difference, still fit."""
    same = patients_small.withColumns({"age": F.lit(40), "cost_estimate": F.lit(None).cast("int")})
    m = M.train_risk_model(same, max_iter=2)
    assert set(m.ensemble.features()) <= {*M.feature_expressions()}
    one = M.train_risk_model(patients_small.withColumn("label", F.lit(1)), max_iter=2)
    assert {r.prediction for r in M.score_patients(one, patients_small.limit(5)).collect()} == {1}


def test_tree_text_round_trip(spark, tmp_path):
    e = trees.Ensemble(((0.1, trees.Split("age", 70.5, trees.Leaf(-1.0), trees.Split(
        "season_Winter", 0.5, trees.Leaf(1 / 3), trees.Leaf(2.0)))), (1.0, trees.Leaf(0.25))))
    assert trees.from_json(trees.to_json(e)) == e and e.features() == ["age", "season_Winter"]
    trees.save(spark, e, str(tmp_path / "trees"))
    trees.save(spark, e, str(tmp_path / "trees"))
    assert trees.load(spark, str(tmp_path / "trees")) == e


def test_margin_by_hand(spark):
    e = trees.Ensemble(((0.5, trees.Split("a", 1.0, trees.Leaf(-1.0), trees.Leaf(2.0))), (1.0, trees.Leaf(0.25))))
    df = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),), (float("-inf"),)], "a double")
    got = [r[0] for r in df.select(trees.margin(e, {"a": F.col("a")})).collect()]
    assert got == [-0.25, 1.25, 1.25, -0.25]
    p = df.select(trees.probability(trees.margin(e, {"a": F.col("a")})).alias("p")).first().p
    assert abs(p - 1 / (1 + math.exp(0.5))) < 1e-15


def test_unknown_features_are_refused(patients_small):
    e = trees.Ensemble(((1.0, trees.Split("height", 1.0, trees.Leaf(0.0), trees.Leaf(1.0))),))
    with pytest.raises(ValueError, match="height"):
        M.score_patients(e, patients_small)
