"""Scores for a stream of new events, relative to the training run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from embertrace.operators.features import Frequencies, feature_matrix
from embertrace.operators.model import Model, training_scores


def score_stream(events: DataFrame, model: Model, frequencies: Frequencies) -> DataFrame:
    """Stateless: saved frequencies are joined in, saved bounds and percentiles are read off.

    A key the training run never saw gets the highest rarity.
    """
    return training_scores(model, feature_matrix(events, frequencies))
