"""Op A1: the patient table.

The application draws random patients; random rows cannot be reproduced by
another engine, so the same columns are derived from ``orders`` left-joined
to its ``lineitem`` count with integer arithmetic (see FIXTURES.md). The
plan is one partial aggregation of ``lineitem`` on its order key, one
shuffle of ``orders`` onto the same partitioning, and a projection; every
score column stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions import scores
from wardflow.sources.tables import read_table

PATIENT_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType(), True),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("specialty", T.StringType(), True),
    T.StructField("cancel_risk", T.DoubleType(), True),
    T.StructField("los", T.IntegerType(), True),
    T.StructField("cost_estimate", T.IntegerType(), True),
    T.StructField("season", T.StringType(), True),
    T.StructField("jitter", T.IntegerType(), True),
    T.StructField("priority_score", T.DoubleType(), True),
    T.StructField("readmit_risk", T.DoubleType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("wait_days", T.IntegerType(), True),
])

BASE_COLUMNS = ["patient_id", "age", "gender", "specialty", "cancel_risk", "los",
                "cost_estimate", "season", "jitter"]


def _specialty(u):
    # Cumulative shares 30/15/25/10/10/5/5 of SPECIALTIES over u in 0..99.
    return (F.when(u < 30, "Orthopedics").when(u < 45, "ENT")
            .when(u < 70, "General Surgery").when(u < 80, "Gynaecology")
            .when(u < 90, "Urology").when(u < 95, "Ophthalmology")
            .otherwise("Cardiology"))


def _season(m):
    return (F.when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer")
            .when(m.between(9, 11), "Autumn").otherwise("Winter"))


def base_patients(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Input columns of the patient table, one row per order."""
    lines = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    joined = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").join(
        lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = F.coalesce(F.col("n_lines"), F.lit(0))
    return joined.select(
        (k + 1).alias("patient_id"),
        (F.lit(18) + (c * 31 + k * 17) % 73).cast("int").alias("age"),
        F.when((k * 7 + c) % 100 < 48, "M").otherwise("F").alias("gender"),
        _specialty((k * 37 + c * 11) % 100).alias("specialty"),
        ((F.lit(5) + (k * 13 + c * 7) % 46).cast("double") / F.lit(100.0)).alias("cancel_risk"),
        F.least(F.lit(10), F.lit(1) + n).cast("int").alias("los"),
        (F.lit(2000) + F.floor("o_totalprice") % 8001).cast("int").alias("cost_estimate"),
        _season(F.month("o_orderdate")).alias("season"),
        ((k * 53 + c * 29) % 31).cast("int").alias("jitter"),
    )


def with_scores(df: DataFrame) -> DataFrame:
    """Adds C1, C2, C3 and C4 to a frame holding the base columns."""
    first = df.withColumns({"priority_score": scores.priority_score(),
                            "readmit_risk": scores.readmit_risk()})
    return first.withColumns({"label": scores.risk_label(), "wait_days": scores.wait_days()})


def patient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the full patient table of PATIENT_SCHEMA."""
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    return with_scores(base_patients(orders, lineitem))


def first_patients(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The first ``n`` patients by ``patient_id`` (A5 on the patient table)
    without deriving the whole table.

    ``patient_id`` is the order key plus one and the join keeps one row per
    order, so the first patients come from the first orders. ``lineitem`` is
    cut to their ``n`` keys by a semi-join before it is aggregated.
    """
    orders = read_table(spark, sf_dir, "orders")
    top = orders.orderBy("o_orderkey").limit(n)
    lineitem = read_table(spark, sf_dir, "lineitem").join(
        top.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return with_scores(base_patients(top, lineitem)).orderBy("patient_id")
