"""

Every query reads the driver's tables (``orders`` with ``lineitem`` for the
patient table; ``conversations`` for the question log) and runs over them
whole. ``oracle_sql`` holds the DuckDB equivalent of each query; of the
library's own, only the four whose values depend on the trained model
(training, scoring, metrics, full run) have none and get the rows-only check.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable

# The package and the oracle module live beside this file.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wardflow import constants as K  # noqa: E402
from wardflow.functions import encoding, scores, trees  # noqa: E402
from wardflow.operators import filters, groups, inspect, queue  # noqa: E402
from wardflow.operators import model as ml  # noqa: E402
from wardflow.operators import questions as qlog  # noqa: E402
from wardflow.plans.answers import answer_questions  # noqa: E402
from wardflow.plans.full_run import run_full  # noqa: E402
from wardflow.sources import sinks  # noqa: E402
from wardflow.sources.patients import first_patients, patient_table  # noqa: E402

# The training-data operators are an optional part; only their absence is
# accepted here, not an error inside them.
try:
    import corpus_pipeline
    from wardflow.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "wardflow.llm", "wardflow.llm.queries"):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Parameters of the registered queries: those of the application's sample
# questions where one exists, else the application's defaults.
SAMPLE_SPECIALTIES = ["Cardiology", "Orthopedics"]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: mean wait for Cardiology and Orthopedics (sample question 1)."""
    return groups.average_wait_time(patient_table(spark, SMOKE_DIR),
                                    specialties=SAMPLE_SPECIALTIES)


def _p(fn, **kw):
    """A query applying ``fn`` to the patient table of ``sf_dir``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(patient_table(spark, sf_dir), **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _cols(**exprs):
    """A query projecting ``patient_id`` and named column expressions."""
    def project(df: DataFrame) -> DataFrame:
        return df.select("patient_id", *[e().alias(n) for n, e in exprs.items()])
    return _p(project)


def _winter_count(df: DataFrame) -> DataFrame:
    return filters.filter_season(df, "Winter").agg(F.count(F.lit(1)).alias("winter_patients"))


def _band_counts(df: DataFrame) -> DataFrame:
    """Band counts of ages spread over 0..144, so that some have no band."""
    spread = F.when(F.col("patient_id") % 2 == 0, F.col("age") * 2 - 36).otherwise(F.col("age"))
    g = (df.groupBy(scores.age_group(spread).alias("age_group"))
           .agg(F.count(F.lit(1)).alias("patient_count")))
    return filters.drop_empty_groups(g, "age_group", "patient_count")


def _dropped_columns(df: DataFrame) -> DataFrame:
    return inspect.validate_columns(df.drop("los", "wait_days"))


def _dropped_pages(df: DataFrame) -> DataFrame:
    return inspect.validate_pages(df.drop("season", "wait_days"))


def _encode(df: DataFrame) -> DataFrame:
    return encoding.one_hot_encode(df, keep=["patient_id"])


def _decode(df: DataFrame) -> DataFrame:
    enc = encoding.one_hot_encode(df, keep=["patient_id"])
    return encoding.one_hot_decode(enc).select("patient_id", "gender", "specialty", "season")


def _fill(df: DataFrame) -> DataFrame:
    """Features of which some ages, stays and risks are missing."""
    enc = encoding.one_hot_encode(df, keep=["patient_id"] + encoding.feature_columns()[:5])
    return encoding.feature_fill(enc.withColumns({
        "age": F.nullif(F.col("age"), F.lit(45)), "los": F.nullif(F.col("los"), F.lit(3)),
        "cancel_risk": F.nullif(F.col("cancel_risk"), F.lit(0.25))}))


def _session_name(spark: SparkSession, name: str) -> str:
    """A table name of this application, so that no query meets a table that
    another one, or an earlier run, has left."""
    return name + "_" + re.sub(r"\W", "_", spark.conf.get("spark.app.id", "app"))


def _write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.write_patient_table(patient_table(spark, sf_dir), _session_name(spark, "patient_written"))


def _adhoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oracle_queries import ADHOC_SQL
    return inspect.adhoc_sql(spark, patient_table(spark, sf_dir), ADHOC_SQL)


_MODELS: dict = {}


def _model(spark: SparkSession, sf_dir: str):
    """G1 fitted once per application and data folder; the registered model
    queries share it (the model is a few trees on the driver, no data)."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _MODELS:
        _MODELS[key] = ml.train_risk_model(patient_table(spark, sf_dir))
    return _MODELS[key]


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    return spark.createDataFrame(
        [(i + 1, n, float(v), len(model.trees)) for i, (n, v) in enumerate(ml.feature_importances(model))],
        "feature_index int, feature string, importance double, num_trees int")


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.score_patients(_model(spark, sf_dir), patient_table(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.model_metrics(_score(spark, sf_dir))


def _fixed_trees(df: DataFrame) -> DataFrame:
    """G2 of a tree file that does not depend on a fit."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "oracle_trees.json")) as f:
        ensemble = trees.from_json(f.read())
    return ml.score_patients(ensemble, df).select(
        "patient_id", "label", "prediction", F.round("score", 9).alias("score"), "percentage")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.feature_vectors(patient_table(spark, sf_dir))


def _fixed_metrics(df: DataFrame) -> DataFrame:
    """G3 of a score that needs no model: the priority score."""
    fixed = df.select("label", F.col("priority_score").alias("score"),
                      (F.col("priority_score") > 0.3).cast("int").alias("prediction"))
    m = ml.model_metrics(fixed)
    return m.select(F.round("train_auc", 9).alias("train_auc"),
                    F.round("train_accuracy", 9).alias("train_accuracy"), "training_rows")


def _full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 from beginning to end, its own training included."""
    return run_full(spark, sf_dir, _session_name(spark, "patient_data")).high_risk_patients


def _full_run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1's list without the model's columns."""
    done = run_full(spark, sf_dir, _session_name(spark, "patient_listed"), model=_model(spark, sf_dir))
    return done.high_risk_patients.drop("prediction", "score", "percentage")


def _first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 on the patient table: the first ten patients by id."""
    return first_patients(spark, sf_dir, K.PREVIEW_ROWS)


def _log(fn):
    """A query applying ``fn`` to the question log of ``sf_dir``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(qlog.question_log(spark, sf_dir))
    return run


def _params(df: DataFrame) -> DataFrame:
    return qlog.extract_question_params(df).select("conv_id", "turn", "variant", "params.*")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_questions(qlog.question_log(spark, sf_dir), patient_table(spark, sf_dir),
                            preview=first_patients(spark, sf_dir, K.PREVIEW_ROWS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    # A: sources
    q["patient_table"] = patient_table
    q["write_patient_table"] = _write_table
    q["write_patient_parquet"] = _p(sinks.write_patient_parquet)
    q["adhoc_sql"] = _adhoc
    q["preview_rows"] = _first_rows
    q["sample_rows"] = _p(inspect.sample_rows, n=1000)
    q["row_count"] = _p(inspect.row_count)
    q["table_profile"] = _p(inspect.table_profile)
    q["table_profile_sample"] = _p(inspect.table_profile, sample=5)
    q["validate_columns"] = _p(_dropped_columns)
    q["validate_page_columns"] = _p(_dropped_pages)
    # B: filters
    q["filter_specialty"] = _p(filters.filter_specialty, specialties=SAMPLE_SPECIALTIES)
    q["filter_age_exact"] = _p(filters.filter_age_exact, age=45)
    q["filter_age_range"] = _p(filters.filter_age_range, age_min=30, age_max=50)
    q["filter_age_group"] = _p(filters.filter_age_group, group="elderly")
    q["filter_high_risk"] = _p(filters.filter_high_risk)
    q["filter_season"] = _p(_winter_count)
    q["drop_empty_groups"] = _p(_band_counts)
    # C: row-level columns
    q["priority_score"] = _cols(priority_score=scores.priority_score)
    q["readmit_risk"] = _cols(readmit_risk=scores.readmit_risk)
    q["risk_label"] = _cols(label=scores.risk_label)
    q["wait_days"] = _cols(wait_days=scores.wait_days)
    q["combined_score"] = _cols(combined_score=scores.combined_score)
    q["cancellation_loss"] = _cols(cancellation_loss=scores.cancellation_loss)
    q["age_group"] = _cols(age=lambda: F.col("age"), age_group=scores.age_group)
    q["clip_upper"] = _cols(
        clipped_priority=lambda: scores.clip_upper(scores.priority_score_raw(), 0.3),
        clipped_readmit=lambda: scores.clip_upper(scores.readmit_risk_raw(), 0.5))
    q["score_percentage"] = _cols(
        percentage=lambda: encoding.score_percentage(scores.readmit_risk()))
    q["one_hot_encode"] = _p(_encode)
    q["one_hot_decode"] = _p(_decode)
    q["feature_fill"] = _p(_fill)
    # E: grouped answers
    q["average_wait_time"] = _p(groups.average_wait_time, specialties=SAMPLE_SPECIALTIES)
    q["specialty_analysis"] = _p(groups.specialty_analysis)
    q["high_risk_by_specialty"] = _p(groups.high_risk_by_specialty, percentage=70)
    q["cost_impact"] = _p(groups.cost_impact, specialties=["Orthopedics"])
    q["seasonal_analysis"] = _p(groups.seasonal_analysis)
    q["age_based_risk"] = _p(groups.age_based_risk, age_min=30, age_max=50)
    q["age_based_cancellation"] = _p(groups.age_based_cancellation)
    q["age_based_cost"] = _p(groups.age_based_cost, age_min=18, age_max=35, age_group="young")
    q["overview_metrics"] = _p(groups.overview_metrics)
    q["specialty_counts"] = _p(groups.specialty_counts)
    q["wait_by_specialty"] = _p(groups.wait_by_specialty)
    q["specialty_performance"] = _p(groups.specialty_performance)
    q["readmit_histogram"] = _p(groups.readmit_histogram)
    q["cancel_risk_by_specialty"] = _p(groups.cancel_risk_by_specialty)
    q["season_counts"] = _p(groups.season_counts)
    q["seasonal_risk"] = _p(groups.seasonal_risk)
    q["most_common_specialty"] = _p(groups.most_common_specialty)
    q["highest_risk_specialty"] = _p(groups.highest_risk_specialty)
    q["average_age"] = _p(groups.average_age)
    q["high_risk_summary"] = _p(groups.high_risk_summary)
    q["cancellation_reduction"] = _p(groups.cancellation_reduction, percentage=15.0)
    # F: queue, capacity, schedule
    q["high_risk_patients"] = _p(queue.high_risk_patients)
    q["queue_position"] = _p(lambda df: queue.queue_position(df).select("patient_id", "queue_position"))
    q["assign_week"] = _p(lambda df: queue.queue_position(df).select(
        "patient_id", queue.assign_week("queue_position", 120).alias("week")))
    q["capacity_scheduled"] = _p(queue.capacity_scheduled)
    q["capacity_summary"] = _p(queue.capacity_summary)
    q["weekly_backlog"] = _p(queue.weekly_backlog, weeks=K.WEEKLY_BACKLOG_WEEKS)
    q["optimized_schedule"] = _p(queue.optimized_schedule)
    q["patients_treated_earlier"] = _p(queue.patients_treated_earlier)
    q["capacity_kpis"] = _p(queue.capacity_kpis, baseline_capacity=200, uplift_percentage=20)
    q["backlog_timeline"] = _p(queue.backlog_timeline, weeks=K.TIMELINE_WEEKS)
    # G, C11, C12, P1: model and full run (rows-only checks)
    q["feature_select"] = _features
    q["train_risk_model"] = _train
    q["score_patients"] = _score
    q["score_fixed_trees"] = _p(_fixed_trees)
    q["model_metrics"] = _metrics
    q["model_metrics_fixed_score"] = _p(_fixed_metrics)
    q["full_run"] = _full_run
    q["full_run_list"] = _full_run_list
    # H: question log (every conversation turn, bare and with a question)
    q["classify_questions"] = _log(lambda df: qlog.classify_questions(df))
    q["extract_question_params"] = _log(_params)
    q["route_questions"] = _log(lambda df: qlog.route_questions(df))
    q["intent_counts"] = _log(qlog.intent_counts)
    q["answer_questions"] = _answers
    if llm_queries is not None:
        q.update(llm_queries.QUERIES)
        q["pipeline"] = corpus_pipeline.run
    return q


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE
    names = queries()
    sql = dict(ORACLE)
    if llm_queries is not None:
        sql.update(llm_queries.ORACLE)
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v for k, v in sql.items() if k in names}
