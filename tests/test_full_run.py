"""Stages, and a run that goes on where it was stopped."""

from __future__ import annotations

import shutil

import pytest

from conftest import SF_SMALL
from wardflow.functions import trees
from wardflow.operators import model as M
from wardflow.plans import full_run as P
from wardflow.sources import sinks

ROUNDS = 3


@pytest.fixture()
def trained(monkeypatch):
    """Counts the trainings."""
    calls = []
    train = M.train_risk_model

    def counted(*args, **kwargs):
        calls.append(1)
        return train(*args, **kwargs)

    monkeypatch.setattr(M, "train_risk_model", counted)
    return calls


def test_killed_after_training_goes_on(spark, tmp_path, monkeypatch, trained):
    where, name = str(tmp_path / "run"), "p1_killed"
    write = sinks.write_patient_table
    monkeypatch.setattr(sinks, "write_patient_table", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        P.run_full(spark, SF_SMALL, name, run_dir=where, rounds=ROUNDS)
    assert len(trained) == 1
    monkeypatch.setattr(sinks, "write_patient_table", write)
    second = P.run_full(spark, SF_SMALL, name, run_dir=where, rounds=ROUNDS)
    assert second.done == ["scores"] and len(trained) == 1
    assert second.df_final.count() == 1500 and second.high_risk_patients.count() > 0
    third = P.run_full(spark, SF_SMALL, name, run_dir=where, rounds=ROUNDS)
    assert third.done == [] and len(trained) == 1
    assert sorted(third.high_risk_patients.collect()) == sorted(second.high_risk_patients.collect())


def test_an_unfinished_stage_is_not_taken_over(spark, tmp_path, trained):
    where, name = tmp_path / "run", "p1_partial"
    P.run_full(spark, SF_SMALL, name, run_dir=str(where), rounds=ROUNDS)
    # A record without its success mark, and an output that is gone.
    (where / "manifest" / "scores" / "_SUCCESS").unlink()
    assert P.run_full(spark, SF_SMALL, name, run_dir=str(where), rounds=ROUNDS).done == ["scores"]
    shutil.move(where / "trees", where / "moved")
    assert P.run_full(spark, SF_SMALL, name, run_dir=str(where), rounds=ROUNDS).done == ["trees"]
    assert len(trained) == 2


def test_changes_run_again_from_where_they_matter(spark, tmp_path, trained):
    inputs = tmp_path / "in"
    inputs.mkdir()
    for t in P.INPUTS:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", inputs / f"{t}.parquet")
    run = lambda **how: P.run_full(
        spark, str(inputs), "p1_changed", run_dir=str(tmp_path / "run"), **how).done
    assert run(rounds=ROUNDS) == ["patients", "trees", "scores"]
    assert run(rounds=ROUNDS + 1) == ["trees", "scores"]
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(1000).coalesce(1).write.mode("overwrite").parquet(
        str(inputs / "orders.parquet.new"))
    part = next((inputs / "orders.parquet.new").glob("part-*.parquet"))
    shutil.copy(part, inputs / "orders.parquet")
    assert run(rounds=ROUNDS + 1) == ["patients", "trees", "scores"]
    assert spark.table("p1_changed").count() == 1000


def test_a_given_model_is_not_trained(spark, trained):
    e = trees.Ensemble(((1.0, trees.Split("age", 70.0, trees.Leaf(-1.0), trees.Leaf(1.0))),))
    done = P.run_full(spark, SF_SMALL, "p1_given", model=e)
    assert done.done == ["patients", "scores"] and not trained
    assert done.df_final.filter("prediction <> cast(age > 70 as int)").count() == 0
    assert done.metrics.first().training_rows == 1500
