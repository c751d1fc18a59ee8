"""Labels derived from amounts and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rainloom.constants import ALERT_DEFAULT, ALERT_LEVELS, OUTCOME_LABELS


def alert_level(probability: Column) -> Column:
    (cut, name), *others = ALERT_LEVELS
    chain = F.when(probability >= cut, name)
    for cut, name in others:
        chain = chain.when(probability >= cut, name)
    return chain.otherwise(ALERT_DEFAULT)


def event(amount: Column, limit: float = 0.0) -> Column:
    """1/0 event label, null where the amount is missing; limit 0 means strictly above 0."""
    return ((amount > 0) if limit == 0 else (amount >= limit)).cast("int")


def outcome(truth: Column, predicted: Column) -> Column:
    """Name of the outcome; null where truth or forecast is missing."""
    chain = None
    for (t, p), name in OUTCOME_LABELS.items():
        hit = (truth == t) & (predicted == p)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain
