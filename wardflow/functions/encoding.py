"""Ops C8-C12: indicator encoding, decoding and model features.

The application one-hot encodes three categoricals with the alphabetically
first value dropped, and folds them back with row-wise lambdas. Here both
directions are column expressions over the fixed value lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow import constants as K

CATEGORICALS = {
    "gender": sorted(K.GENDERS),
    "specialty": sorted(K.SPECIALTIES),
    "season": sorted(K.SEASONS),
}


def indicator_columns() -> dict[str, list[str]]:
    """Indicator names per categorical, first alphabetical value dropped."""
    return {c: [f"{c}_{v}" for v in vals[1:]] for c, vals in CATEGORICALS.items()}


def feature_columns() -> list[str]:
    """C11: 5 numeric + 1 + 6 + 3 = 15 model features, in table order."""
    out = list(K.NUMERIC_FEATURES)
    for names in indicator_columns().values():
        out += names
    return out


def one_hot_encode(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Replace gender/specialty/season with 0/1 indicator columns."""
    cols = [c for c in df.columns if c not in CATEGORICALS] if keep is None else keep
    ind = [(F.col(cat) == v).cast("int").alias(f"{cat}_{v}")
           for cat, vals in CATEGORICALS.items() for v in vals[1:]]
    return df.select(*cols, *ind)


def _decode(df: DataFrame, cat: str) -> Column:
    names = [c for c in df.columns if c.startswith(f"{cat}_")]
    if cat == "gender":
        return F.when(F.col("`gender_M`").cast("int") == 1, "M").when(
            F.col("`gender_M`").cast("int") == 0, "F")
    first = [F.when(F.col(f"`{n}`").cast("int") == 1, F.lit(n[len(cat) + 1:])) for n in names]
    return F.coalesce(*first, F.lit(K.ENCODED_DEFAULTS[cat]))


def one_hot_decode(df: DataFrame) -> DataFrame:
    """Fold indicators back into gender, specialty and season. The first
    indicator equal to 1 wins; none gives Cardiology / Autumn."""
    out = df
    for cat in CATEGORICALS:
        if any(c.startswith(f"{cat}_") for c in df.columns):
            out = out.withColumn(cat, _decode(df, cat))
    return out


def feature_fill(df: DataFrame) -> DataFrame:
    """Missing feature values become 0."""
    return df.fillna(0, subset=[c for c in feature_columns() if c in df.columns])


def score_percentage(score: str | Column = "score") -> Column:
    """round(100 * score, 2), half to even."""
    s = F.col(score) if isinstance(score, str) else score
    return F.bround(s * F.lit(100.0), 2)
