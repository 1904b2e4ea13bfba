"""H1-H3, H5 against the fixture table, generated questions and DuckDB."""

from __future__ import annotations

import random
import re
import time

import pytest
from brute import parameter_question
from pyspark.sql import functions as F
from fixtures import QUESTIONS
from wardflow import constants as K
from wardflow.functions import text
from wardflow.operators import questions as Q

EXTRA = [
    "Éent ENT-ward analysis", "age45 risk", "aged 45 and 1234 risk", "threshold of 0.8 risk",
    "risk weight 0.4 please", "young adult and elderly readmission risk", "middle-aged cost",
    "between 20 to 30 what cost by age", "1.5.3 numbers 10 20", "cardiology\r\nwait",
    "average\nwait time", "High-risk cases", "UPLIFT 5% capacity", "general surgery, urology!",
    "children segment cancellations", "senior adults cost", "",
]


@pytest.fixture(scope="module")
def prepared(spark):
    rows = [(i, q) for i, q, *_ in QUESTIONS] + [(100 + i, q) for i, q in enumerate(EXTRA)]
    df = spark.createDataFrame(rows, "question_id bigint, question string")
    return {r.question_id: r for r in Q.prepare_questions(df).collect()}


def test_fixture_intents_and_routes(prepared):
    for qid, _q, intent, route in QUESTIONS:
        assert (prepared[qid].intent, prepared[qid].route) == (intent, route), qid


def test_stated_differences(prepared):
    assert prepared[15].params.specialties == ["ENT"]
    p14 = prepared[14].params
    assert (p14.age_group, p14.age_min, p14.age_max) == ("young adult", 18, 35)
    p7 = prepared[7].params
    assert (p7.age_group, p7.age_min, p7.age_max) == ("young", 18, 35)


def test_intent_counts(spark):
    df = spark.createDataFrame([(i, q) for i, q, *_ in QUESTIONS], "question_id bigint, question string")
    got = {r.intent: r.question_count for r in Q.intent_counts(df).collect()}
    want: dict = {}
    for _i, _q, intent, _r in QUESTIONS:
        want[intent] = want.get(intent, 0) + 1
    assert got == want


def plain(q: str) -> str:
    """The first pattern found by Python's own engine."""
    return next((n for n, p in K.QUESTION_PATTERNS if re.search(p, q.lower())), K.DEFAULT_INTENT)


def test_the_log_asks_everything(spark):
    log = Q.question_log(spark, "/root/testdata/sf0.01")
    rows = Q.prepare_questions(log).collect()
    assert len(rows) == 2 * spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    assert {r.intent for r in rows} == {n for n, _ in K.QUESTION_PATTERNS} | {K.DEFAULT_INTENT}
    assert len({r.route for r in rows}) == 11
    for field in rows[0].params.asDict():
        assert any(r.params[field] is not None for r in rows), field
    assert all(r.intent == plain(r.question) for r in rows)


def test_generated_parameters_are_found(spark):
    rng = random.Random(8)
    made = [parameter_question(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(made)], "question_id bigint, question string")
    for r in Q.extract_question_params(df).collect():
        got = {k: v for k, v in r.params.asDict().items() if v is not None}
        assert got == made[r.question_id][1], r.question


def test_capacities_are_never_replaced(spark):
    texts = ["baseline capacity 99999999999", "baseline capacity 99999999999999999999999", "capacity", "x",
             "baseline capacity, then nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, question string")
    got = {r.question_id: r.params.baseline_capacity for r in Q.extract_question_params(df).collect()}
    assert got == {0: 99999999999, 1: None, 2: 100, 3: None, 4: 100}


def test_guards_are_necessary_conditions():
    from wardflow.functions.text import necessary_literals
    assert necessary_literals("(colou?r).*(x)") == [[["colo"], ["x"]]]
    assert necessary_literals("(a)?.*(bc*)") == [[["b"]]] and necessary_literals("(.a)") is None
    texts = [q for _i, q, *_ in QUESTIONS] + EXTRA
    for _name, pattern in K.QUESTION_PATTERNS:
        lits = necessary_literals(pattern)
        for t in texts:
            low = t.lower()
            if re.search(pattern, low):
                assert any(all(any(x in low for x in g) for g in branch) for branch in lits)


@pytest.mark.parametrize("glue", ["", " "])
def test_linear_patterns_find_what_the_plain_ones_find(spark, glue):
    rng = random.Random(3)
    words = sorted({w for _, p in K.QUESTION_PATTERNS for w in re.findall(r"[a-z-]+", p)})
    words += ["high risk", "5", "%", "\n", "\r", "x", "ren", "al", "ing", "y", "é"]
    texts = [glue.join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 40])))
             for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, q string")
    out = df.select("id", *[F.col("q").rlike(text.linear_regex(p)).alias(n) for n, p in K.QUESTION_PATTERNS])
    for r in out.collect():
        for n, p in K.QUESTION_PATTERNS:
            assert r[n] == bool(re.search(p, texts[r.id])), (n, texts[r.id])


def test_linear_numbers_find_what_the_plain_ones_find(spark):
    rng = random.Random(4)
    parts = ["baseline capacity", "baseline\ncapacity", "risk weight", "risk-weight", "threshold", "5", "12.5",
             "%", "7%", "1.2.3%", "\n", "x", " ", "9."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    forms = {"b": (text.number_after(K.BASELINE_CAPACITY_PATTERN), K.BASELINE_CAPACITY_PATTERN),
             "r": (text.number_after(K.RISK_WEIGHT_PATTERN), K.RISK_WEIGHT_PATTERN),
             "t": (text.number_after(K.THRESHOLD_PATTERN), K.THRESHOLD_PATTERN),
             "p": (text.percent_regex(K.PERCENT_PATTERN), K.PERCENT_PATTERN)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, q string")
    for r in df.select("id", *[F.regexp_extract("q", f, 1).alias(k) for k, (f, _) in forms.items()]).collect():
        for k, (_, p) in forms.items():
            m = re.search(p, texts[r.id])
            assert r[k] == (m.group(1) if m else ""), (k, texts[r.id])


@pytest.mark.parametrize("line", ["average wait " * 8000, "time " + "average wait " * 8000,
                                  "baseline capacity " * 6000, "risk weight " * 8000, "9" * 100_000 + "x %",
                                  "a " * 50_000 + "\n" + "average " * 12_000])
def test_long_lines_take_no_longer_than_their_length(spark, line):
    def run(t):
        df = spark.createDataFrame([(t,)], "question string")
        began = time.time()
        Q.prepare_questions(df).select("intent", "params").collect()
        return time.time() - began
    run("warm up")
    short = run("age 5")
    assert run(line) < short + 2


def test_words_and_numbers_against_plain_patterns(spark):
    """One pattern for all words, and cheap first characters, find what the
    application's single patterns find."""
    rng = random.Random(11)
    bits = [*K.QUESTION_SPECIALTIES, *K.AGE_GROUPS, "young ", "adult", "_", " ", "é", "-", ".", "1", "2.5", "30%", "x", "\n",
            "between 3 to 4", "between 5 and 66", "aged 7", "age 1234", "ENT", "Young Adult", "٣", "gynaecologyx"]
    texts = ["".join(rng.choices([*bits, " "], k=rng.randrange(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, question string")
    got = {r.i: r.params for r in Q.extract_question_params(df).collect()}
    for i, t in enumerate(texts):
        low, p = t.lower(), got[i]
        found = [s for s in K.QUESTION_SPECIALTIES if re.search(rf"\b{re.escape(s)}\b", low)]
        assert (p.specialties or []) == [next((n for n in K.SPECIALTIES if n.lower() == s), s.title()) for s in found], t
        group = None
        for g in K.AGE_GROUPS:
            guard = "(?<!young )" if g == "adult" else ""
            group = g if re.search(rf"{guard}\b{re.escape(g)}\b", low) else group
        assert p.age_group == group, t
        numbers = re.findall(K.NUMBER_PATTERN.replace(r"\d", "[0-9]"), t)
        assert (p.numbers or []) == [float(x) for x in numbers], t
        span = re.search(K.AGE_RANGE_PATTERN.replace(r"\d", "[0-9]"), low)
        if group is None:
            assert (p.age_min, p.age_max) == ((int(span[1]), int(span[2])) if span else (None, None)), t


def test_parameters_scan_each_text_a_few_times(spark):
    """One regex a parameter (two more cut the short span of a range)."""
    df = spark.createDataFrame([(1, "x")], "i int, question string")
    plan = Q.extract_question_params(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 0 and plan.count("regexp_extract") <= 11 and plan.count("Contains(") <= 8
