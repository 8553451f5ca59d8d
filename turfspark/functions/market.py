"""Scalar column functions on odds, probabilities and stakes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfspark import constants as C


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = C.LOGIT_EPS) -> Column:
    bounded = clip(p, eps, 1.0 - eps)
    return F.ln(bounded / (1.0 - bounded))


def logit_delta(newer: Column, older: Column, eps: float = C.LOGIT_EPS) -> Column:
    return logit(newer, eps) - logit(older, eps)


def implied(odds: Column) -> Column:
    return F.when(odds > 0, 1.0 / odds)


def _both_positive(lower: Column, upper: Column) -> Column:
    return (lower > 0) & (upper > 0)


def place_mid(lower: Column, upper: Column) -> Column:
    return F.when(_both_positive(lower, upper), 1.0 / F.sqrt(lower * upper))


def place_width(lower: Column, upper: Column) -> Column:
    ratio = F.greatest(lower, upper) / F.least(lower, upper)
    return F.when(_both_positive(lower, upper), F.ln(ratio))


def expected_profit(p: Column, odds: Column) -> Column:
    return p * odds - 1.0


def kelly(p: Column, odds: Column) -> Column:
    edge = F.when(odds > 1, (p * odds - 1.0) / (odds - 1.0))
    usable = (p > 0) & (p < 1) & (odds > 1)
    return F.when(usable, F.greatest(edge, F.lit(0.0))).otherwise(0.0)


def fractional_kelly(p: Column, odds: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(scale > 0, scale * kelly(p, odds)).otherwise(0.0)


def floor_to_unit(amount: Column, unit: Column | int) -> Column:
    unit = unit if isinstance(unit, Column) else F.lit(unit)
    steps = F.floor(amount / unit.cast("double"))
    return F.when(amount > 0, (steps * unit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def log_loss(y: Column, p: Column) -> Column:
    bounded = clip(p, C.PROB_EPS, 1.0 - C.PROB_EPS)
    return -F.when(y == 1, F.ln(bounded)).otherwise(F.ln(1.0 - bounded))


def squared_error(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)
