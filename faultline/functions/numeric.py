"""Numeric columns: clamps, sigmoids and score normalisers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def display_score(x: Column) -> Column:
    """[0,1] as is, (1,2] to 1, beyond that a shifted sigmoid."""
    return (F.when((x >= 0) & (x <= 1), x).when((x > 1) & (x <= 2), F.lit(1.0))
            .when(x > 2, clamp01(sigmoid(x - 2))).otherwise(clamp01(sigmoid(x + 1))))


def recall_score(raw: Column, batch_max: Column) -> Column:
    """Inner product to [0,1]: relative to the batch maximum when that exceeds 1, else clamped."""
    return F.when((batch_max > 1) & (raw > 0), F.round(raw / batch_max, 4)).otherwise(clamp01(raw))


def severity_label(score: Column) -> Column:
    from ..rules.crash_rules import SEVERITY_LABELS
    out = None
    for limit, label in SEVERITY_LABELS:
        out = F.when(score >= limit, F.lit(label)) if out is None else out.when(score >= limit, F.lit(label))
    return out.otherwise(F.lit("UNCERTAIN"))
