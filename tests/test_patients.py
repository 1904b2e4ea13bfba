"""A1 and the score columns: fixture counts, domains, boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.functions import scores
from wardflow.sources.patients import BASE_COLUMNS, PATIENT_SCHEMA, with_scores


def test_schema(patients_small):
    assert [(f.name, f.dataType) for f in patients_small.schema.fields] == \
        [(f.name, f.dataType) for f in PATIENT_SCHEMA.fields]


def test_fixture_counts_sf001(patients_mid):
    df = patients_mid
    assert df.count() == 15000
    spec = {r.specialty: r["count"] for r in df.groupBy("specialty").count().collect()}
    assert spec == {"Orthopedics": 4475, "General Surgery": 3793, "ENT": 2214, "Gynaecology": 1529,
                    "Urology": 1514, "Cardiology": 739, "Ophthalmology": 736}
    season = {r.season: r["count"] for r in df.groupBy("season").count().collect()}
    assert season == {"Spring": 3989, "Summer": 3783, "Winter": 3749, "Autumn": 3479}
    assert df.filter("label = 1").count() == 1736
    assert df.filter(F.col("readmit_risk") > F.lit(0.7)).count() == 197
    assert df.filter(F.col("readmit_risk") == F.lit(0.7)).count() == 28


def test_domains(patients_mid):
    r = patients_mid.agg(F.min("age"), F.max("age"), F.min("cancel_risk"), F.max("cancel_risk"),
                         F.min("los"), F.max("los"), F.min("cost_estimate"),
                         F.max("cost_estimate"), F.min("wait_days"), F.max("wait_days")).first()
    assert 18 <= r[0] and r[1] <= 90
    assert r[2] >= 0.05 and r[3] <= 0.5
    assert 1 <= r[4] and r[5] <= 10
    assert 2000 <= r[6] and r[7] <= 10000
    assert (r[8], r[9]) == (34, 127)


def _table(spark, rows):
    schema = ("patient_id bigint, age int, gender string, specialty string, cancel_risk double, "
              "los int, cost_estimate int, season string, jitter int")
    return with_scores(spark.createDataFrame(rows, schema))


def test_threshold_rows(spark):
    rows = [
        (1, 70, "M", "ENT", 0.05, 3, 5000, "Spring", 0),
        (2, 71, "F", "ENT", 0.05, 4, 5001, "Spring", 0),
        (3, 70, "M", "Cardiology", 0.5, 5, 6000, "Winter", 0),
        (4, 71, "F", "Cardiology", 0.5, 6, 6001, "Winter", 0),
        (5, 40, "F", "Urology", 0.1, 1, 3000, "Autumn", 30),
        (6, 40, "F", "Dermatology", 0.1, 1, 3000, "Monsoon", 0),
    ]
    got = {r.patient_id: r for r in _table(spark, rows).collect()}

    def prio(age, los, cost, spec_w, season_w):
        p = 0.0
        p += 0.15 if age > 70 else 0.0
        p += 0.15 if los > 3 else 0.0
        p += 0.15 if cost > 5000 else 0.0
        p += spec_w
        p += season_w
        return min(p, 1.0)

    assert got[1].priority_score == prio(70, 3, 5000, 0.03, 0.0)
    assert got[2].priority_score == prio(71, 4, 5001, 0.03, 0.0)
    assert got[3].priority_score == prio(70, 5, 6000, 0.15, 0.07)
    assert got[5].priority_score == prio(40, 1, 3000, 0.11, 0.03)
    # unknown specialty and season weigh nothing
    assert got[6].priority_score == 0.0
    assert got[1].readmit_risk == 0.0 + 0.2 * 0.05
    r4 = 0.0 + 0.2 + 0.2 + 0.2 * 0.5 + 0.2 + 0.2
    assert got[4].readmit_risk == min(r4, 1.0) and got[4].label == 1
    assert got[5].wait_days == int(100 - got[5].priority_score * 100) + 30


def test_age_bands(spark):
    ages = [0, 1, 17, 18, 35, 36, 60, 61, 120, 121, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = [r.g for r in df.select(scores.age_group().alias("g")).collect()]
    assert got == [None, "Child", "Child", "Young Adult", "Young Adult", "Adult", "Adult",
                   "Elderly", "Elderly", None, None]


def test_base_columns_order():
    assert BASE_COLUMNS == [f.name for f in PATIENT_SCHEMA.fields][:9]


def test_no_python_in_plans(spark, patients_small):
    from __spark_entry__ import queries
    skip = {"train_risk_model", "score_patients", "model_metrics", "full_run", "full_run_list", "feature_select",
            "write_patient_table", "write_patient_parquet"}
    for name, fn in queries().items():
        if name in skip or name == "pipeline" or (name.startswith("op") and name[2].isdigit()):
            continue
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_scan_prunes_columns(spark):
    from wardflow.operators import groups
    from wardflow.sources.patients import patient_table
    plan = groups.average_wait_time(patient_table(spark, "/root/testdata/sf0.001"))._jdf \
        .queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "o_orderstatus" not in plan


def test_every_operator_accepts_an_empty_table(patients_small):
    from wardflow.operators import groups, queue
    empty = patients_small.limit(0)
    for fn in [groups.average_wait_time, groups.specialty_analysis, groups.high_risk_by_specialty,
               groups.cost_impact, groups.seasonal_analysis, groups.age_based_risk,
               groups.age_based_cancellation, groups.age_based_cost, groups.specialty_counts,
               groups.wait_by_specialty, groups.specialty_performance, groups.readmit_histogram,
               groups.cancel_risk_by_specialty, groups.season_counts, groups.seasonal_risk,
               groups.most_common_specialty, groups.highest_risk_specialty]:
        assert fn(empty).count() == 0, fn.__name__
    one_row = [groups.overview_metrics, groups.average_age, groups.high_risk_summary,
               groups.cancellation_reduction, queue.capacity_summary, queue.patients_treated_earlier]
    for fn in one_row:
        assert fn(empty).count() == 1, fn.__name__
    h = groups.high_risk_summary(empty).first()
    assert h.high_risk_patient_count == 0 and h.avg_cost_high_risk == 0.0
    assert not h.potential_intervention_needed
    assert queue.capacity_scheduled(empty).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouped_answers_aggregate_map_side(patients_small):
    from wardflow.operators import groups
    plan = _plan(groups.specialty_analysis(patients_small))
    assert "partial_avg" in plan and "partial_count" in plan
    assert "Exchange hashpartitioning(specialty" in plan


def test_high_risk_sort_is_range_partitioned(spark):
    from wardflow.operators import queue
    from wardflow.sources.patients import patient_table
    plan = _plan(queue.high_risk_patients(patient_table(spark, "/root/testdata/sf0.001")))
    assert "rangepartitioning(readmit_risk" in plan and "SinglePartition" not in plan
