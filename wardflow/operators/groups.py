"""Ops E1-E21: grouped answers over the patient table.

All are hash aggregations with map-side partial aggregation, so a hot
group (one specialty holding a third of the rows) is pre-aggregated in
every task before the shuffle; the shuffled data is one partial row per
group per task. Averages of double columns and sums of doubles are rounded
to 6 places (their last bits depend on summation order); averages of
integer columns are exact and left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions import scores
from wardflow.operators import filters

DOUBLE_PLACES = 6


def r6(c: Column) -> Column:
    """Round an order-dependent double result to 6 places."""
    return F.round(c, DOUBLE_PLACES)


def _threshold(percentage: float | None) -> float:
    p = K.HIGH_RISK_PERCENT_DEFAULT if percentage is None else percentage
    return float(p) / 100


# --- answers to typed questions (E1-E8) -----------------------------------

def average_wait_time(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    """Specialty -> mean wait days, patient count."""
    return (filters.filter_specialty(df, specialties).groupBy("specialty")
            .agg(F.avg("wait_days").alias("avg_wait_days"),
                 F.count("patient_id").alias("patient_count")))


def specialty_analysis(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    """Specialty -> count and mean wait, cost, cancel and readmit risk."""
    return (filters.filter_specialty(df, specialties).groupBy("specialty")
            .agg(F.count("patient_id").alias("patient_count"),
                 F.avg("wait_days").alias("avg_wait_days"),
                 F.avg("cost_estimate").alias("avg_cost"),
                 r6(F.avg("cancel_risk")).alias("avg_cancel_risk"),
                 r6(F.avg("readmit_risk")).alias("avg_readmit_risk")))


def high_risk_by_specialty(df: DataFrame, percentage: float | None = None,
                           specialties: Sequence[str] | None = None) -> DataFrame:
    """Patients above percentage/100 risk (default 70) by specialty."""
    hr = filters.filter_specialty(filters.filter_high_risk(df, _threshold(percentage)),
                                  specialties)
    return (hr.groupBy("specialty")
            .agg(F.count("patient_id").alias("high_risk_count"),
                 r6(F.avg("readmit_risk")).alias("avg_risk"),
                 F.avg("cost_estimate").alias("avg_cost")))


def cost_impact(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    """Specialty -> total and mean cost, count, expected cancellation loss."""
    return (filters.filter_specialty(df, specialties).groupBy("specialty")
            .agg(F.sum("cost_estimate").alias("total_cost"),
                 F.avg("cost_estimate").alias("avg_cost"),
                 F.count("cost_estimate").alias("patient_count"),
                 r6(F.sum(scores.cancellation_loss())).alias("potential_loss_from_cancellations")))


def seasonal_analysis(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    """E5: season -> mean cancel risk, count; highest mean first. A season
    named in a question does not filter."""
    return (filters.filter_specialty(df, specialties).groupBy("season")
            .agg(r6(F.avg("cancel_risk")).alias("avg_cancel_risk"),
                 F.count("patient_id").alias("total_cases"))
            .orderBy(F.desc("avg_cancel_risk"), F.asc("season")))


def _banded(df: DataFrame, **age_filter) -> DataFrame:
    return (filters.apply_age_filter(df, **age_filter)
            .withColumn("age_group", scores.age_group())
            .withColumn("age_group_ord", scores.age_group_ord()))


def age_based_risk(df: DataFrame, **age_filter) -> DataFrame:
    """Age band -> mean readmit risk, count; in band order."""
    g = (_banded(df, **age_filter).groupBy("age_group", "age_group_ord")
         .agg(r6(F.avg("readmit_risk")).alias("avg_readmit_risk"),
              F.count("patient_id").alias("total_patients")))
    return (filters.drop_empty_groups(g, "age_group", "total_patients")
            .orderBy("age_group_ord").drop("age_group_ord"))


def age_based_cancellation(df: DataFrame, **age_filter) -> DataFrame:
    """Age band -> mean cancel risk, count; highest mean first."""
    g = (_banded(df, **age_filter).groupBy("age_group")
         .agg(r6(F.avg("cancel_risk")).alias("avg_cancel_risk"),
              F.count("patient_id").alias("total_patients")))
    return (filters.drop_empty_groups(g, "age_group", "total_patients")
            .orderBy(F.desc("avg_cancel_risk"), F.asc("age_group")))


def age_based_cost(df: DataFrame, **age_filter) -> DataFrame:
    """Age band -> mean cost, total cost, count; highest mean first."""
    g = (_banded(df, **age_filter).groupBy("age_group")
         .agg(F.avg("cost_estimate").alias("avg_cost"),
              F.sum("cost_estimate").alias("total_cost"),
              F.count("cost_estimate").alias("patient_count")))
    return (filters.drop_empty_groups(g, "age_group", "patient_count")
            .orderBy(F.desc("avg_cost"), F.asc("age_group")))


# --- dashboard aggregates (E9-E19) ------------------------------------------

def overview_metrics(df: DataFrame) -> DataFrame:
    """One row of headline figures."""
    return df.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.avg("wait_days").alias("avg_wait_days"),
        F.count_if(F.col("readmit_risk") > F.lit(K.HIGH_RISK_THRESHOLD)).alias("high_risk_patients"),
        F.sum("cost_estimate").alias("total_cost"))


def specialty_counts(df: DataFrame) -> DataFrame:
    """Specialty -> count and share of all patients; largest first.

    The share window runs over the aggregated groups only (one row per
    specialty), never over patient rows.
    """
    g = df.groupBy("specialty").agg(F.count(F.lit(1)).alias("patient_count"))
    total = F.sum("patient_count").over(Window.partitionBy())
    return (g.withColumn("share", r6(F.col("patient_count") / total))
             .orderBy(F.desc("patient_count"), F.asc("specialty")))


def wait_by_specialty(df: DataFrame) -> DataFrame:
    """Specialty -> mean wait days; longest first."""
    return (df.groupBy("specialty").agg(F.avg("wait_days").alias("avg_wait_days"))
              .orderBy(F.desc("avg_wait_days"), F.asc("specialty")))


def specialty_performance(df: DataFrame) -> DataFrame:
    """E2 without a filter, every figure rounded half-even to 2 places."""
    return (df.groupBy("specialty")
            .agg(F.count("patient_id").alias("patient_count"),
                 F.bround(F.avg("wait_days"), 2).alias("avg_wait_days"),
                 F.bround(F.avg("cost_estimate"), 2).alias("avg_cost"),
                 F.bround(F.avg("cancel_risk"), 2).alias("avg_cancel_risk"),
                 F.bround(F.avg("readmit_risk"), 2).alias("avg_readmit_risk")))


def readmit_histogram(df: DataFrame, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Counts over equal-width bins of readmit risk on [0, 1]."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("readmit_risk") * F.lit(float(bins)))).cast("int")
    return (df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("patient_count"))
              .withColumn("bin_start", F.col("bin") / F.lit(float(bins)))
              .withColumn("bin_end", (F.col("bin") + 1) / F.lit(float(bins)))
              .orderBy("bin"))


def cancel_risk_by_specialty(df: DataFrame) -> DataFrame:
    """Specialty -> mean cancel risk; highest first."""
    return (df.groupBy("specialty").agg(r6(F.avg("cancel_risk")).alias("avg_cancel_risk"))
              .orderBy(F.desc("avg_cancel_risk"), F.asc("specialty")))


def season_counts(df: DataFrame) -> DataFrame:
    """Season -> count; largest first."""
    return (df.groupBy("season").agg(F.count(F.lit(1)).alias("patient_count"))
              .orderBy(F.desc("patient_count"), F.asc("season")))


def seasonal_risk(df: DataFrame) -> DataFrame:
    """Season -> mean cancel and readmit risk, half-even to 3 places."""
    return df.groupBy("season").agg(
        F.bround(F.avg("cancel_risk"), 3).alias("avg_cancel_risk"),
        F.bround(F.avg("readmit_risk"), 3).alias("avg_readmit_risk"))


def most_common_specialty(df: DataFrame) -> DataFrame:
    """The mode of specialty; the smallest name on a tie."""
    return (df.groupBy("specialty").agg(F.count(F.lit(1)).alias("patient_count"))
              .orderBy(F.desc("patient_count"), F.asc("specialty")).limit(1))


def highest_risk_specialty(df: DataFrame) -> DataFrame:
    """The specialty with the highest mean readmit risk; first name on a tie."""
    return (df.groupBy("specialty").agg(F.avg("readmit_risk").alias("avg_readmit_risk"))
              .orderBy(F.desc("avg_readmit_risk"), F.asc("specialty")).limit(1)
              .select("specialty", r6(F.col("avg_readmit_risk")).alias("avg_readmit_risk")))


def average_age(df: DataFrame) -> DataFrame:
    """Mean age."""
    return df.agg(F.avg("age").alias("avg_age"))


# --- function answers (E20, E21) --------------------------------------------

def high_risk_summary(df: DataFrame, percentage: float | None = None) -> DataFrame:
    """Count above the threshold, the threshold, mean cost of those
    patients (0 when none) and whether any intervention is needed."""
    t = _threshold(percentage)
    agg = filters.filter_high_risk(df, t).agg(
        F.count(F.lit(1)).alias("high_risk_patient_count"),
        F.avg("cost_estimate").alias("_avg_cost"))
    return agg.select(
        "high_risk_patient_count",
        F.lit(t).alias("risk_threshold"),
        F.bround(F.coalesce(F.col("_avg_cost"), F.lit(0.0)), 2).alias("avg_cost_high_risk"),
        (F.col("high_risk_patient_count") > 0).alias("potential_intervention_needed"))


def cancellation_reduction(df: DataFrame, percentage: float | None = None) -> DataFrame:
    """What-if of preventing ``percentage`` percent (default 20) of the
    expected cancellations; one aggregation, then scalar arithmetic."""
    p = float(K.UPLIFT_PERCENT_DEFAULT if percentage is None else percentage)
    agg = df.agg(F.sum("cancel_risk").alias("_expected"),
                 F.avg("cost_estimate").alias("_avg_cost"),
                 F.avg("los").alias("_avg_los"))
    prevented = F.col("_expected") * F.lit(p / 100)
    bed_days = prevented * F.col("_avg_los")
    return agg.select(
        F.bround(F.col("_expected"), 2).alias("current_expected_cancellations"),
        F.bround(prevented, 2).alias("cancellations_prevented"),
        F.bround(prevented * F.col("_avg_cost"), 2).alias("cost_savings"),
        F.bround(bed_days, 2).alias("bed_days_freed"),
        F.bround(bed_days / F.lit(float(K.DAYS_PER_WEEK)) * F.lit(float(K.OPERATING_DAYS_PER_WEEK)),
                 2).alias("weekly_capacity_freed"),
        F.lit(p).alias("reduction_percentage"))
