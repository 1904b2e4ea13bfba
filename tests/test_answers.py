"""H4: every answered question equals its direct operator."""

from __future__ import annotations

import re

from fixtures import QUESTIONS
from pyspark.sql import functions as F

from wardflow.operators import groups as G
from wardflow.operators import inspect, queue
from wardflow.operators import questions as Q
from wardflow.plans.answers import answer_key, answer_questions


def _direct(pt, r):
    p, route = r.params, r.route
    spec = p.specialties
    age = dict(age=p.age, age_min=p.age_min, age_max=p.age_max, age_group=p.age_group,
               specialties=spec)
    table = {
        "average_wait_time": (lambda: G.average_wait_time(pt, spec), "specialty"),
        "specialty_analysis": (lambda: G.specialty_analysis(pt, spec), "specialty"),
        "high_risk_by_specialty": (lambda: G.high_risk_by_specialty(pt, p.percentage, spec), "specialty"),
        "cost_impact": (lambda: G.cost_impact(pt, spec), "specialty"),
        "seasonal_analysis": (lambda: G.seasonal_analysis(pt, spec), "season"),
        "age_based_risk": (lambda: G.age_based_risk(pt, **age), "age_group"),
        "age_based_cancellation": (lambda: G.age_based_cancellation(pt, **age), "age_group"),
        "age_based_cost": (lambda: G.age_based_cost(pt, **age), "age_group"),
        "cancellation_reduction": (lambda: G.cancellation_reduction(pt, p.percentage), None),
        "capacity_kpis": (lambda: queue.capacity_kpis(
            pt, p.baseline_capacity or 100, 20 if p.percentage is None else p.percentage)
            .drop("monthly_revenue_increase"), None),
        "preview_rows": (lambda: inspect.preview_rows(pt), "patient_id"),
    }
    make, key = table[route]
    out = {}
    for row in make().collect():
        d = row.asDict()
        g = d.pop(key) if key else None
        for m, v in d.items():
            out[(None if g is None else str(g), m)] = v if isinstance(v, str) else float(v)
    return out


def test_answers_equal_direct_operators(spark, patients_small):
    qdf = spark.createDataFrame([(i, q) for i, q, *_ in QUESTIONS], "question_id bigint, question string")
    got: dict = {}
    for r in answer_questions(qdf, patients_small).collect():
        got.setdefault(r.question_id, {})[(r.group_key, r.metric)] = (
            r.value if r.text_value is None else r.text_value)
    prep = {r.question_id: r for r in Q.prepare_questions(qdf).collect()}
    for qid, *_ in QUESTIONS:
        assert got.get(qid, {}) == _direct(patients_small, prep[qid]), (qid, prep[qid].route)


def test_unknown_specialty_has_no_rows(spark, patients_small):
    qdf = spark.createDataFrame([(1, "average wait time for dermatology")],
                                "question_id bigint, question string")
    rows = answer_questions(qdf, patients_small).collect()
    # no specialty named: every specialty answers
    assert {r.group_key for r in rows} == {r.specialty for r in
                                           patients_small.select("specialty").distinct().collect()}


def test_unread_parameters_do_not_part_keys(spark, patients_small):
    texts = [f"What is the cost impact for Orthopedics? reference {i}, threshold 0.{i}" for i in range(300)]
    texts += [f"age {20 + i % 3} risk, reference {i}" for i in range(90)]
    qdf = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, question string")
    prep = Q.prepare_questions(qdf).select(answer_key(F.col("route"), F.col("params")).alias("k"))
    assert prep.distinct().count() == 1 + 3
    assert answer_questions(qdf, patients_small).filter("route = 'cost_impact'").count() == 300 * 4


def test_a_key_meets_its_groups_only(spark, patients_small):
    """Rows out of the joins of the look-ups follow the keys, not keys x cells."""
    from wardflow.plans import answers as A
    base = A.base_cells(patients_small).cache()
    texts = [f"risk between {a} and {a + 9} by age" for a in range(10, 60)]
    texts += [f"high risk patients above {p}%" for p in range(1, 99)]
    qdf = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, question string")
    prep = Q.prepare_questions(qdf).select(answer_key(F.col("route"), F.col("params")).alias("_pk")).distinct()
    keys = prep.select("_pk", F.from_json("_pk", A._KEY).alias("k")).select("_pk", "k.*")
    band, risk = A._band_answers(keys, base.filter("kind = 'sa'")), A._risk_answers(keys, base)
    assert band.count() <= 50 * 4 and risk.count() == 98 * 7

    def joined(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return max(int(x) for x in re.findall(r"rows=(\d+)", _rows(plan)) or ["0"])
    # 8 x 121: the table of running sums itself (ages 0..120, 7 specialties and all).
    assert joined(band) <= max(50 * 4 * 2, 8 * 121) and joined(risk) <= 98 * 7


def _rows(plan) -> str:
    """``rows=`` of every join in an executed plan."""
    out, todo = "", [plan]
    while todo:
        p = todo.pop()
        if "Adaptive" in p.nodeName():
            p = p.executedPlan()
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
            continue
        if "Join" in p.nodeName():
            out += f"rows={p.metrics().apply('numOutputRows').value()} "
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_huge_capacities_and_percentages(spark, patients_small):
    texts = ["baseline capacity 9000000000000000000 increase by 500%", "capacity increase 99999999999999999999%",
             "baseline capacity 0 increase by 5%"]
    qdf = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, question string")
    got = {(r.question_id, r.metric): r.value for r in answer_questions(qdf, patients_small).collect()}
    assert got[(0, "baseline_capacity")] == 9e18 and got[(0, "new_capacity")] == 5.4e19
    assert got[(0, "patients_moved_earlier")] == 0 and got[(2, "new_capacity")] == 0


def test_repeated_questions_share_answers(spark, patients_small):
    q = "What is the cost impact for Orthopedics?"
    rows = [(i, q) for i in range(1, 31)] + [(100, "Reduce cancellations by 15%")]
    qdf = spark.createDataFrame(rows, "question_id bigint, question string")
    out = answer_questions(qdf, patients_small)
    per_q: dict = {}
    for r in out.collect():
        per_q.setdefault(r.question_id, set()).add((r.group_key, r.metric, r.value))
    assert len(per_q) == 31
    first = per_q[1]
    assert len(first) == 4 and all(per_q[i] == first for i in range(2, 31))


def test_random_questions_equal_direct_operators(spark, patients_small):
    import random
    rng = random.Random(5)
    heads = ["average wait time", "specialty breakdown", "high risk patients", "cost impact",
             "seasonal analysis", "risk by age", "cancellations by age", "cost by age group",
             "reduce cancellations by", "capacity increase", "baseline capacity"]
    mods = ["for Cardiology", "for ENT and urology", "general surgery", "orthopedics, gynaecology",
            "elderly", "young", "children", "senior", "middle-aged", "age 40", "aged 71",
            "between 20 and 45", "between 50 to 90", "25%", "70%", "12.5%", "150", ""]
    texts = [f"{rng.choice(heads)} {rng.choice(mods)} {rng.choice(mods)}".strip() for _ in range(60)]
    qdf = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, question string")
    got: dict = {}
    for r in answer_questions(qdf, patients_small).collect():
        got.setdefault(r.question_id, {})[(r.group_key, r.metric)] = (
            r.value if r.text_value is None else r.text_value)
    for r in Q.prepare_questions(qdf).collect():
        assert got.get(r.question_id, {}) == _direct(patients_small, r), (r.question, r.route)


def test_branches_without_questions(spark, patients_small):
    only_preview = spark.createDataFrame([(1, "hello there")], "question_id bigint, question string")
    rows = answer_questions(only_preview, patients_small).collect()
    assert {r.route for r in rows} == {"preview_rows"} and len(rows) == 10 * 12
    only_grouped = spark.createDataFrame([(1, "cost impact for ENT")], "question_id bigint, question string")
    rows = answer_questions(only_grouped, patients_small).collect()
    assert {r.route for r in rows} == {"cost_impact"} and len(rows) == 4
    empty = answer_questions(only_preview.limit(0), patients_small)
    assert empty.count() == 0
    assert empty.columns == ["question_id", "intent", "route", "group_key", "metric", "value",
                             "text_value"]


def test_answer_plan_has_no_pairwise_join(spark, patients_small):
    qdf = spark.createDataFrame([(i, q) for i, q, *_ in QUESTIONS], "question_id bigint, question string")
    plan = answer_questions(qdf, patients_small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
