"""Op P1: the full run, restartable.

patient table (A1 with C1-C4) -> boosted trees (C3, C8-C11, G1) -> scores and
table write (G2, C12, A2) -> metrics (G3) and high-risk list (F1).

The patients are derived once, into a written table that training and scoring
both read. A run with a ``run_dir`` keeps a manifest there: one record for each
finished stage, with a fingerprint of all that the stage depends on (the input
files' names, sizes and times, the parameters, the fingerprint of the stage
before) and what it left. A record is written after the stage's output is
complete, by a job that Spark commits as a whole. A run that was stopped goes
on behind the last stage whose record fits and whose output is still there;
changed inputs or parameters run again from the first stage they reach.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from wardflow import constants as K
from wardflow.functions import trees
from wardflow.operators import model as M
from wardflow.operators import queue
from wardflow.session import path_exists, scratch_path
from wardflow.sources import sinks
from wardflow.sources.patients import patient_table
from wardflow.sources.tables import file_states

INPUTS = ("orders", "lineitem")


@dataclass
class FullRunResult:
    df_final: DataFrame
    model: M.RiskModel | GBTClassificationModel | trees.Ensemble
    metrics: DataFrame
    high_risk_patients: DataFrame
    #: Stages that this run did itself; the others were taken over.
    done: list[str] = field(default_factory=list)


class Manifest:
    """The finished stages of a run, as small JSON tables in its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/manifest"

    def read(self, stage: str) -> dict | None:
        path = f"{self.folder}/{stage}"
        # _SUCCESS is there once the record is whole.
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            return None
        rows = self.spark.read.text(path).take(1)
        return json.loads(rows[0].value) if rows else None

    def write(self, stage: str, record: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(record),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.folder}/{stage}")


def fingerprint(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def run_full(spark: SparkSession, sf_dir: str, table_name: str = "patient_data", fmt: str = "parquet",
             model: M.RiskModel | GBTClassificationModel | trees.Ensemble | None = None,
             threshold: float = K.HIGH_RISK_THRESHOLD, run_dir: str | None = None,
             rounds: int = K.MODEL_ROUNDS) -> FullRunResult:
    """Build, train, score, persist and analyse the patient table.

    ``run_dir`` (a shared folder) makes the run restartable; without one its
    tables go to the application's scratch folder. A given ``model`` takes the
    place of training.
    """
    folder = run_dir.rstrip("/") if run_dir else scratch_path(spark, "full-run")
    manifest, done = Manifest(spark, folder), []

    def stage(name: str, depends: str, work: Callable[[], str]) -> str:
        """Where the stage's output is: as recorded, if that still holds."""
        record = manifest.read(name) if run_dir else None
        if record and record["fingerprint"] == depends and sinks.output_exists(spark, record["output"]):
            return record["output"]
        output = work()
        done.append(name)
        if run_dir:
            manifest.write(name, {"fingerprint": depends, "output": output})
        return output

    inputs = fingerprint("patients", sf_dir, [file_states(spark, sf_dir, t) for t in INPUTS] if run_dir else None)
    patients = spark.read.parquet(stage("patients", inputs, lambda: _written(
        patient_table(spark, sf_dir), f"{folder}/patients")))

    fitted = model
    if model is None:
        def train() -> str:
            nonlocal fitted
            fitted = M.train_risk_model(patients, max_iter=rounds)
            trees.save(spark, fitted.ensemble, f"{folder}/trees")
            return f"{folder}/trees"

        learned = fingerprint("trees", inputs, rounds, K.MODEL_BINS, K.MODEL_MAX_DEPTH, K.MODEL_STEP_SIZE,
                              K.MODEL_SUBSAMPLE, K.MODEL_SEED)
        saved = stage("trees", learned, train)
        fitted = trees.load(spark, saved) if fitted is None else fitted
    else:
        learned = fingerprint("given", inputs, trees.to_json(M.ensemble_of(model)))

    def score() -> str:
        sinks.write_patient_table(M.score_patients(fitted, patients), table_name, fmt)
        return f"table:{table_name}"

    stage("scores", fingerprint("scores", learned, table_name, fmt), score)
    final = spark.table(table_name)
    return FullRunResult(df_final=final, model=fitted, metrics=M.model_metrics(final),
                         high_risk_patients=queue.high_risk_patients(final, threshold), done=done)


def _written(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path
