"""Every registered query with an oracle agrees with DuckDB (values and
types), at sf0.001."""

from __future__ import annotations

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle_check import SPARK_TO_DUCK, compare, duck

SF = "/root/testdata/sf0.001"
# Those of the optional part are tested with it.
NAMES = sorted(n for n in oracle_sql() if not (n.startswith("op") and n[2].isdigit()))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    ok, msg = compare(rows, df.columns, res.fetchall(), [c[0] for c in res.description])
    assert ok, msg
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in df.schema.fields}
    assert stypes == {c[0]: str(c[1]) for c in res.description}


def test_entry(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert {r.specialty for r in rows} == {"Cardiology", "Orthopedics"}


def test_every_query_has_oracle_or_is_listed():
    rows_only = {"train_risk_model", "score_patients", "model_metrics", "full_run"}
    own = {n for n in queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())}
    assert own - set(oracle_sql()) == rows_only


def test_grouped_answers_random_parameters(spark, con, patients_small):
    import random

    from oracle_queries import AGE_GROUP, d, iavg, with_patients
    from wardflow.operators import groups
    rng = random.Random(3)
    specs = ["Cardiology", "ENT", "General Surgery", "Gynaecology", "Ophthalmology",
             "Orthopedics", "Urology", "Dermatology"]
    for _ in range(12):
        chosen = rng.sample(specs, rng.randint(0, 3))
        lo = rng.randint(0, 90)
        hi = lo + rng.randint(0, 40)
        exact = rng.choice([None, None, rng.randint(18, 90)])
        pct = rng.choice([None, 40, 55.5, 70, 85])
        sp = (" AND specialty IN (" + ", ".join(f"'{x}'" for x in chosen) + ")") if chosen else ""
        age = f"age = {exact}" if exact is not None else f"age BETWEEN {lo} AND {hi}"
        cases = [
            (groups.average_wait_time(patients_small, chosen),
             f"SELECT specialty, {iavg('wait_days')} AS avg_wait_days, count(*) AS patient_count "
             f"FROM patients WHERE TRUE{sp} GROUP BY specialty"),
            (groups.high_risk_by_specialty(patients_small, pct, chosen),
             f"SELECT specialty, count(*) AS high_risk_count, round(avg(readmit_risk), 6) AS avg_risk, "
             f"{iavg('cost_estimate')} AS avg_cost FROM patients "
             f"WHERE readmit_risk > {d((70 if pct is None else pct) / 100)}{sp} GROUP BY specialty"),
            (groups.age_based_cost(patients_small, age=exact, age_min=lo, age_max=hi, specialties=chosen),
             f"SELECT age_group, {iavg('cost_estimate')} AS avg_cost, "
             "CAST(sum(cost_estimate) AS BIGINT) AS total_cost, count(*) AS patient_count FROM "
             f"(SELECT *, {AGE_GROUP} AS age_group FROM patients WHERE {age}{sp}) b "
             "WHERE age_group IS NOT NULL GROUP BY age_group"),
        ]
        for df, sql in cases:
            res = con.execute(with_patients(sql))
            ok, msg = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(),
                              [c[0] for c in res.description])
            assert ok, (chosen, lo, hi, exact, pct, msg)
