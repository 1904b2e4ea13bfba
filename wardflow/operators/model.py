"""Ops G1-G3 (+ C11, C12): the readmission-risk classifier.

Boosted trees of depth 3, step 0.1, 50 rounds, subsample 0.8, seed 42 over the
15 features of the application (5 numeric + gender, specialty and season
indicators over the fixed value lists, the alphabetically first value dropped).
An unknown value has no indicator and is scored with weight 0.

**Training (G1)** derives the patients once, into a narrow table of the feature
columns. The five numeric features are cut at quantiles into at most
``MODEL_BINS`` bins (as many as the tree learner would tell apart itself), and
patients that agree in all bins, the three categories and the label become one
cell with their number as its weight. The rounds of ``pyspark.ml`` run over the
cells, whose number is bounded by the value domains and not by the patients.
Each round's subsample is drawn from the cells. A bin's number is at most k where
the value is at most the k-th cut, so the trees are then stated in the features'
own values.

**Scoring (G2)** writes the trees as one expression (``functions.trees``).
Exact tree equality with another boosting library is not a goal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions import encoding, scores, trees
from wardflow.operators.inspect import sample_rows
from wardflow.session import release, reliable_checkpoint

#: Cells per task of the training rounds.
CELLS_PER_TASK = 50_000
#: Relative error of the quantiles: one in so many rows.
QUANTILE_ACCURACY = 10_000


@dataclass
class RiskModel:
    """A fitted model: the booster over bin numbers, the cuts between the
    bins, and its trees in the features' own values."""
    booster: GBTClassificationModel
    cuts: dict[str, list[float]]
    ensemble: trees.Ensemble

    @property
    def trees(self) -> list:
        return self.booster.trees

    @property
    def numFeatures(self) -> int:  # noqa: N802 - as the booster names it
        return self.booster.numFeatures

    @property
    def featureImportances(self):  # noqa: N802
        return self.booster.featureImportances


def feature_expressions() -> dict[str, Column]:
    """C11: the 15 features by name: numeric columns with C10 fills, and the
    C8 indicators, as doubles without nulls."""
    numeric = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in K.NUMERIC_FEATURES}
    indicators = {f"{cat}_{v}": F.coalesce((F.col(cat) == v).cast("double"), F.lit(0.0))
                  for cat, values in encoding.CATEGORICALS.items() for v in values[1:]}
    return numeric | indicators


def with_features(df: DataFrame) -> DataFrame:
    """C11: adds ``features``, the 15-wide vector. No pass over the data."""
    named = {f"_f{i}": e for i, e in enumerate(feature_expressions().values())}
    return VectorAssembler(inputCols=list(named), outputCol="features").transform(df.withColumns(named)).drop(*named)


def feature_cuts(df: DataFrame, bins: int = K.MODEL_BINS) -> dict[str, list[float]]:
    """Quantiles that cut each numeric feature into at most ``bins`` bins."""
    at = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(feature_expressions()[c], at, QUANTILE_ACCURACY).alias(c)
                     for c in K.NUMERIC_FEATURES]).first()
    return {c: sorted(set(found[c] or [])) for c in K.NUMERIC_FEATURES}


def _cuts_below(value: Column, cuts: list[float], first: int = 0) -> Column:
    """Number of cuts below ``value``, by halving: a row meets log2 of them."""
    if not cuts:
        return F.lit(float(first))
    mid = len(cuts) // 2
    return F.when(value <= F.lit(cuts[mid]), _cuts_below(value, cuts[:mid], first)).otherwise(
        _cuts_below(value, cuts[mid + 1:], first + mid + 1))


def bin_numbers(cuts: dict[str, list[float]]) -> dict[str, Column]:
    """Each numeric feature as the number of cuts below its value."""
    values = feature_expressions()
    return {c: _cuts_below(values[c], cuts[c]) for c in K.NUMERIC_FEATURES}


def training_cells(df: DataFrame, bins: int = K.MODEL_BINS) -> tuple[DataFrame, dict[str, list[float]]]:
    """The training table: ``label``, the binned features and ``weight``, the
    number of patients that agree in them; and the cuts. One pass over ``df``."""
    label = F.col("label") if "label" in df.columns else scores.risk_label()
    known = {cat: F.when(F.col(cat).isin(values[1:]), F.col(cat)) for cat, values in encoding.CATEGORICALS.items()}
    narrow = reliable_checkpoint(df.select(
        label.cast("double").alias("label"), *[c.alias(n) for n, c in known.items()],
        *[e.alias(c) for c, e in feature_expressions().items() if c in K.NUMERIC_FEATURES]), "training-rows")
    cuts = feature_cuts(narrow, bins)
    binned = narrow.select("label", *encoding.CATEGORICALS, *[
        _cuts_below(F.col(c), cuts[c]).alias(c) for c in K.NUMERIC_FEATURES])
    cells = binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    cells = reliable_checkpoint(cells, "training-cells")
    release(narrow)
    return cells, cuts


def train_risk_model(df: DataFrame, max_iter: int = K.MODEL_ROUNDS,
                     max_training_rows: int | None = None, bins: int = K.MODEL_BINS) -> RiskModel:
    """G1: boosted trees on the labelled patient table. ``max_training_rows``
    (off by default) fits on that many rows, chosen by a seeded hash."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxDepth=K.MODEL_MAX_DEPTH,
                        stepSize=K.MODEL_STEP_SIZE, maxIter=max_iter, maxBins=max(bins, 2),
                        subsamplingRate=K.MODEL_SUBSAMPLE, seed=K.MODEL_SEED)
    if max_training_rows is not None:
        df = sample_rows(df, max_training_rows)
    cells, cuts = training_cells(df, bins)
    parts = max(1, -(-cells.count() // CELLS_PER_TASK))
    # Dealt by the cell, so that the rounds' subsamples do not depend on tasks.
    train = with_features(cells.repartition(parts, *cells.columns)).select("label", "weight", "features").persist()
    try:
        booster = gbt.fit(train)
    finally:
        train.unpersist()
        release(cells)

    def own_value(feature: str, threshold: float) -> float:
        # Bins up to floor(threshold) go left: values up to that cut.
        return cuts[feature][math.floor(threshold)] if feature in cuts else threshold

    ensemble = trees.from_spark(booster, encoding.feature_columns()).moved(own_value)
    return RiskModel(booster, cuts, ensemble)


def ensemble_of(model: RiskModel | GBTClassificationModel | trees.Ensemble) -> trees.Ensemble:
    """The trees of a model, in the features' own values."""
    if isinstance(model, trees.Ensemble):
        return model
    return model.ensemble if isinstance(model, RiskModel) else trees.from_spark(model, encoding.feature_columns())


def score_patients(model: RiskModel | GBTClassificationModel | trees.Ensemble, df: DataFrame) -> DataFrame:
    """Every row with ``prediction``, ``score`` = P(label 1) and its
    percentage rounded to 2 places (C12). ``model`` is G1's, a booster fitted
    on ``with_features``, or an ensemble read from a tree file."""
    ensemble = ensemble_of(model)
    labelled = df if "label" in df.columns else df.withColumn("label", scores.risk_label())
    values = feature_expressions()
    unknown = set(ensemble.features()) - set(values)
    if unknown:
        raise ValueError(f"the trees read unknown features: {sorted(unknown)}")
    # The features are columns of a projection of their own, computed once a row.
    places = {f: f"_wf_f{i}" for i, f in enumerate(ensemble.features())}
    wide = labelled.withColumns({places[f]: values[f] for f in places})
    scored = wide.withColumn("_wf_m", trees.margin(ensemble, {f: F.col(p) for f, p in places.items()}))
    return scored.select(
        *[F.col(f"`{c}`") for c in labelled.columns],
        (F.col("_wf_m") > 0).cast("int").alias("prediction"),
        trees.probability(F.col("_wf_m")).alias("score"),
    ).withColumn("percentage", encoding.score_percentage("score"))


def model_metrics(scored: DataFrame) -> DataFrame:
    """AUC and accuracy on the training rows, as one row.

    The two figures need two passes; the (label, score, prediction) columns
    are written once to the checkpoint folder so the rows are scored once.
    """
    scored = reliable_checkpoint(scored.select("label", "score", "prediction"), "scores")
    # numBins=0: the exact area (no down-sampling of the curve); the curve
    # is built and integrated as a distributed sort and sliding sum.
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score",
                                        metricName="areaUnderROC", numBins=0).evaluate(
        scored.withColumn("label", F.col("label").cast("double")))
    return scored.agg(
        F.lit(auc).alias("train_auc"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("train_accuracy"),
        F.count(F.lit(1)).alias("training_rows"))


def feature_vectors(df: DataFrame) -> DataFrame:
    """C11 as data: ``patient_id`` and the assembled features as an array."""
    return with_features(df).select("patient_id", vector_to_array("features").alias("features"))


def feature_importances(model: RiskModel | GBTClassificationModel) -> list[tuple[str, float]]:
    """(feature name, importance) of a fitted model, in vector order."""
    return list(zip(encoding.feature_columns(), model.featureImportances.toArray().tolist(), strict=True))
