"""Row-level score columns (ops C1-C7, C13) as JVM-side expressions.

Every fractional constant is a double literal and the terms are added in
the fixed order, so threshold tests (``readmit_risk > 0.7``) agree with the
reference bit for bit.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow import constants as K


def _zero() -> Column:
    return F.lit(0.0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _term(cond: Column, weight: float) -> Column:
    return F.when(cond, F.lit(float(weight))).otherwise(_zero())


def _lookup(key: Column, weights: dict[str, float]) -> Column:
    """Weight of ``key`` from a fixed table; 0.0 for unknown values."""
    expr = None
    for name, w in weights.items():
        expr = (F.when(key == name, F.lit(float(w))) if expr is None
                else expr.when(key == name, F.lit(float(w))))
    return expr.otherwise(_zero())


def _ordered_sum(terms: list[Column]) -> Column:
    return reduce(lambda acc, t: acc + t, terms, _zero())


def clip_upper(x, cap: float = K.SCORE_CAP) -> Column:
    """min(x, cap)."""
    return F.least(_col(x), F.lit(float(cap)))


def priority_score_raw(age="age", los="los", cost="cost_estimate",
                       specialty="specialty", season="season") -> Column:
    return _ordered_sum([
        _term(_col(age) > K.PRIORITY_AGE_OVER, K.PRIORITY_AGE_W),
        _term(_col(los) > K.PRIORITY_LOS_OVER, K.PRIORITY_LOS_W),
        _term(_col(cost) > K.PRIORITY_COST_OVER, K.PRIORITY_COST_W),
        _lookup(_col(specialty), K.PRIORITY_SPECIALTY_W),
        _lookup(_col(season), K.PRIORITY_SEASON_W),
    ])


def priority_score(**cols) -> Column:
    """Capped weighted sum of age, stay, cost, specialty and season."""
    return _default_priority() if not cols else clip_upper(priority_score_raw(**cols))


@lru_cache(maxsize=1)
def _default_priority() -> Column:
    # Column expressions are immutable trees: the default one is built once.
    return clip_upper(priority_score_raw())


def readmit_risk_raw(age="age", los="los", cancel_risk="cancel_risk",
                     cost="cost_estimate", season="season") -> Column:
    return _ordered_sum([
        _term(_col(age) > K.RISK_AGE_OVER, K.RISK_AGE_W),
        _term(_col(los) > K.RISK_LOS_OVER, K.RISK_LOS_W),
        F.lit(K.RISK_CANCEL_W) * _col(cancel_risk),
        _term(_col(cost) > K.RISK_COST_OVER, K.RISK_COST_W),
        _term(_col(season) == "Winter", K.RISK_WINTER_W),
    ])


def readmit_risk(**cols) -> Column:
    """Capped weighted sum of age, stay, cancel risk, cost and winter."""
    return _default_readmit() if not cols else clip_upper(readmit_risk_raw(**cols))


@lru_cache(maxsize=1)
def _default_readmit() -> Column:
    return clip_upper(readmit_risk_raw())


def risk_label(risk="readmit_risk") -> Column:
    """1 when the readmission risk is above 0.5."""
    return (_col(risk) > F.lit(K.LABEL_RISK_OVER)).cast("int")


def wait_days(priority="priority_score", jitter="jitter") -> Column:
    """C4: truncated 100 - 100 * priority, plus the stored per-row jitter."""
    base = F.floor(F.lit(100.0) - _col(priority) * F.lit(100.0)).cast("int")
    return base + _col(jitter).cast("int")


def combined_score(risk_weight: float = K.RISK_WEIGHT_DEFAULT,
                   priority="priority_score", risk="readmit_risk") -> Column:
    """Priority * (1 - w) + risk * w."""
    w = float(risk_weight)
    return _col(priority) * F.lit(1.0 - w) + _col(risk) * F.lit(w)


def cancellation_loss(cost="cost_estimate", cancel_risk="cancel_risk") -> Column:
    """Expected loss from a cancellation."""
    return _col(cost) * _col(cancel_risk)


def age_group(age="age") -> Column:
    """Right-closed age bands; ages outside (0, 120] get null."""
    a = _col(age)
    expr = None
    for lo, hi, name in K.AGE_BANDS:
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def age_group_ord(age="age") -> Column:
    """Band number 0..3 matching ``age_group`` (for ordering), else null."""
    a = _col(age)
    expr = None
    for i, (lo, hi, _name) in enumerate(K.AGE_BANDS):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr
