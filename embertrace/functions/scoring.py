"""Column expressions on scores: rarity, normalisation, routing, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.text import lookup, strip


def rarity(count: Column, total: Column, usable: Column) -> Column:
    """``ln(1 + total/count)``; 0 for a missing key, ``ln(1 + total)`` for an unseen one."""
    total = total.cast("double")
    return (
        F.when(~usable, F.lit(0.0))
        .when(count.isNull() | (count == 0), F.log1p(total))
        .otherwise(F.log1p(total / count))
    )


def min_max_inverted(raw: Column, lo: Column, hi: Column) -> Column:
    """Raw score on [0, 1] where the lowest raw score maps to the top."""
    return F.lit(1.0) - (raw - lo) / (hi - lo + F.lit(fv.SCORE_EPSILON))


def score_route(score: Column, is_anomaly: Column) -> Column:
    """Route by score alone."""
    return (
        F.when(~F.coalesce(is_anomaly, F.lit(False)), F.lit("auto-close"))
        .when(score >= fv.TIER1_SCORE, F.lit("tier-1"))
        .otherwise(F.lit("tier-2"))
    )


def reply_confidence(label: Column) -> Column:
    """Confidence that an alert is real, from the false-positive label of the reply."""
    return lookup(F.lower(strip(label)), fv.REPLY_CONFIDENCE, fv.REPLY_CONFIDENCE_DEFAULT)


def combined_confidence_raw(score: Column, percentile: Column, confidence: Column) -> Column:
    """Geometric mean of score, percentile share and reply confidence, unrounded."""
    share = F.coalesce(percentile / 100.0, score)
    return F.pow(score * share * confidence, F.lit(1.0 / 3.0))


def fused_route(combined: Column) -> Column:
    """Route by the unrounded combined confidence."""
    return (
        F.when(combined >= fv.HIGH_PRIORITY_CONFIDENCE, F.lit("high_priority"))
        .when(combined >= fv.REVIEW_CONFIDENCE, F.lit("analyst_review"))
        .otherwise(F.lit("auto-close"))
    )


def disagreement(score: Column, confidence: Column) -> Column:
    """The model is sure, the reply is not."""
    return (score > fv.DISAGREEMENT_SCORE) & (confidence < fv.DISAGREEMENT_CONFIDENCE)


def to_number(value: Column) -> Column:
    """Number of a text, null when it is none."""
    return value.try_cast("double")
