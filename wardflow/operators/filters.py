"""Ops B1-B7: row filters with typed parameters.

Each is a plain ``filter`` so Catalyst pushes it as far down as it can (to
the parquet scan for columns that come straight from a file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow import constants as K


def filter_specialty(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    """B1: keep the listed specialties; an empty or missing list keeps all."""
    if not specialties:
        return df
    return df.filter(F.col("specialty").isin(list(specialties)))


def filter_age_exact(df: DataFrame, age: int) -> DataFrame:
    """B2: ``age == x``."""
    return df.filter(F.col("age") == int(age))


def filter_age_range(df: DataFrame, age_min: int, age_max: int) -> DataFrame:
    """``age_min <= age <= age_max``."""
    return df.filter(F.col("age").between(int(age_min), int(age_max)))


def filter_age_group(df: DataFrame, group: str) -> DataFrame:
    """A named group; elderly/senior means any age above 60."""
    if group in ("elderly", "senior"):
        return df.filter(F.col("age") > 60)
    if group not in K.AGE_GROUPS:
        return df
    lo, hi = K.AGE_GROUPS[group]
    return filter_age_range(df, lo, hi)


def apply_age_filter(df: DataFrame, age: int | None = None, age_min: int | None = None,
                     age_max: int | None = None, age_group: str | None = None,
                     specialties: Sequence[str] | None = None) -> DataFrame:
    """The age filter of the age-banded answers: exact age first, then a
    range, then a named group; then the specialty list."""
    if age is not None:
        df = filter_age_exact(df, age)
    elif age_min is not None and age_max is not None:
        df = filter_age_range(df, age_min, age_max)
    elif age_group is not None:
        df = filter_age_group(df, age_group)
    return filter_specialty(df, specialties)


def filter_high_risk(df: DataFrame, threshold: float = K.HIGH_RISK_THRESHOLD) -> DataFrame:
    """``readmit_risk > threshold``, strict."""
    return df.filter(F.col("readmit_risk") > F.lit(float(threshold)))


def filter_season(df: DataFrame, season: str = "Winter") -> DataFrame:
    """Rows of one season."""
    return df.filter(F.col("season") == season)


def drop_empty_groups(df: DataFrame, key: str, count_col: str) -> DataFrame:
    """Drop the null group and groups without rows after a group-by."""
    return df.filter(F.col(key).isNotNull() & (F.col(count_col) > 0))
