"""Ops H1-H3, H5: a log of typed questions, classified, parsed and routed.

The application handles one question at a time on the driver; here the
questions are a DataFrame, and every step is a column expression in one
narrow stage (no shuffle) until ``intent_counts`` groups them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions import text
from wardflow.sources.tables import read_table


# Questions that the log of ``conversations`` is asked. ``{x}`` stands for a
# value derived from the turn, see ``asked``.
ASKED = [
    "What is the average wait time for {spec} and {spec2}?",
    "Show me high risk patients with readmission risk above {pct}%",
    "Reduce cancellations by {pct}%",
    "What is the cost impact for {spec}?",
    "What is the cost impact by specialty?",
    "Show seasonal analysis for Winter",
    "What is the average cost for young adults?",
    "Impact of Baseline capacity {cap} and Capacity Increase by {pct}%",
    "average cost of hernia surgery, reference {ref}",
    "boost throughput by {pct}",
    "increase the cancellation rate by {pct}",
    "Which season has the highest cost?",
    "readmission in winter",
    "young adult readmission risk in {spec}",
    "{spec} specialty breakdown",
    "which season is worst for waiting",
    "age {age} risk",
    "risk between {age} and {older} by age",
    "cancellations by age group",
    "elderly cancellation figures, reference {ref}",
    "average waiting days with threshold 0.{pct} and risk weight 0.{pct}",
    "seasonal readmission in {spec}",
    "senior segment cost for {spec}",
    "middle-aged cancellation rate between {age} to {older}",
    "seasonal comparison of {spec} and {spec2}",
    "capacity increase for aged {age} patients",
]


def asked(conv_id: Column, turn: Column) -> Column:
    """The question that a turn is asked: a template and its values, chosen by
    the turn's key."""
    names = F.array(*[F.lit(x) for x in K.SPECIALTIES])
    age = F.lit(18) + (conv_id * 5 + turn) % 60
    values = {
        "spec": names[((conv_id + turn) % 7).cast("int")],
        "spec2": names[((conv_id + turn * 3 + 2) % 7).cast("int")],
        "age": age,
        "older": age + 1 + conv_id % 25,
        "pct": F.lit(1) + (conv_id * 11 + turn) % 99,
        "cap": F.lit(50) + (conv_id * 13 + turn * 7) % 400,
        "ref": F.lit(1000) + (conv_id * 31 + turn * 17) % 9000,
    }
    which = (conv_id * 7 + turn * 3) % len(ASKED)
    out = None
    for i, template in enumerate(ASKED):
        parts = [values[x[1:-1]].cast("string") if x.startswith("{") else F.lit(x)
                 for x in re.split(r"(\{\w+\})", template) if x]
        out = F.when(which == i, F.concat(*parts)) if out is None else out.when(which == i, F.concat(*parts))
    return out


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the ``conversations`` table twice, whole text: as it is
    (variant 0), and with a question behind it (variant 1)."""
    conv = read_table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("long")
    both = F.array(
        F.struct(F.lit(0).alias("variant"), F.col("text").alias("question")),
        F.struct(F.lit(1).alias("variant"), F.concat(
            F.coalesce("text", F.lit("")), F.lit("\n"), asked(F.col("conv_id"), turn)).alias("question")))
    return conv.select("conv_id", "turn", F.explode(both).alias("q")).select("conv_id", "turn", "q.*")


def classify_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """H1: adds ``intent``; patterns in fixed order, first match wins."""
    return df.withColumn("intent", text.classify(F.col(question)))


def extract_question_params(df: DataFrame, question: str = "question") -> DataFrame:
    """H2: adds ``params``, a struct of the typed parameters."""
    return df.withColumn("params", text.extract_params(F.col(question)))


def route_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """H3: adds ``route``, the operation answering each question."""
    if "intent" not in df.columns:
        df = classify_questions(df, question)
    return df.withColumn("route", text.route(F.col("intent"), F.col(question)))


def prepare_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """H1 + H2 + H3 in one projection."""
    return route_questions(extract_question_params(classify_questions(df, question), question),
                           question)


def intent_counts(df: DataFrame, question: str = "question") -> DataFrame:
    """H5: number of questions per detected intent."""
    if "intent" not in df.columns:
        df = classify_questions(df, question)
    return df.groupBy("intent").agg(F.count(F.lit(1)).alias("question_count"))
