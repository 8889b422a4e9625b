"""Scoring models as column expressions; now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.text import HIGH_SIGNAL

# Weights of the models.
BASE_RATE, CORROBORATION, W_EXTRACT, NEUTRAL, W_CRISP, W_MENTION, W_CONFLICT, LOW, HIGH = 0.70, 0.8, 1.5, 0.7, 0.4, 2.0, 1.0, 0.05, 0.99
SALIENCE = {"entity_density": 0.25, "link_density": 0.20, "has_conflict": 0.10, "type_hint_bump": 0.15, "is_compound": 0.10, "recency": 0.20}
DECAY_FLOOR, INVALIDATED = 0.15, 0.15


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column) -> Column:
    p = clamp(p, 0.01, 0.99)
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def edge_confidence(extraction: Column, subject_mention: Column, object_mention: Column, crisp: Column, corroborating: Column, conflicted: Column, base_rate: float = BASE_RATE, weight: float = CORROBORATION) -> Column:
    """Probability that an edge holds, from what is known; unknown signals say nothing."""
    z = logit(F.lit(base_rate))
    z += F.coalesce(W_EXTRACT * (extraction - NEUTRAL), F.lit(0.0))
    z += W_CRISP * F.when(crisp, 1.0).otherwise(-1.0)
    z += F.coalesce(W_MENTION * (F.least(subject_mention, object_mention) - 1), F.lit(0.0))
    z += weight * F.log2(1 + F.greatest(corroborating, F.lit(0)))
    z -= F.when(conflicted, W_CONFLICT).otherwise(0.0)
    return clamp(sigmoid(z), LOW, HIGH)


def trust(invalidated: Column, verdict: Column, auto_confirmed: Column) -> Column:
    """rejected if invalidated, then a latest confirm, then what confirms itself, else proposed."""
    return F.when(invalidated, "rejected").when(verdict == "confirm", "confirmed").when(auto_confirmed, "auto_confirmed").otherwise("proposed")


def auto_confirm(confidence: Column, crisp: Column, entrenchment: Column, has_evidence: Column, floor: float = 0.75) -> Column:
    return (entrenchment > 0) & has_evidence & (confidence >= floor) & crisp


def recency(age: Column, days: float = 30.0) -> Column:
    """Linear from 1 now to 0 at `days`; of unknown age 0."""
    return F.coalesce(clamp(1 - age / days, 0.0, 1.0), F.lit(0.0))


def salience(entities: Column, links: Column, conflict: Column, type_hint: Column, compound: Column, age: Column, weights: dict[str, float] | None = None) -> Column:
    w = weights or SALIENCE
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    total = (
        w["entity_density"] * F.least(F.lit(1.0), entities / 5) + w["link_density"] * F.least(F.lit(1.0), links / 10) + w["has_conflict"] * one(conflict)
        + w["type_hint_bump"] * one(F.lower(F.trim(type_hint)).isin(*HIGH_SIGNAL)) + w["is_compound"] * one(compound) + w["recency"] * recency(age)
    )
    return clamp(total, 0.0, 1.0)


def age_decay(age: Column, half_life: float) -> Column:
    return F.greatest(F.lit(DECAY_FLOOR), F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life))


def temporal_factor(class_: Column, closure: Column, age: Column, days_to_next: Column, days_past_horizon: Column) -> Column:
    """How much a row still matters by its temporal class. days_to_next: to the next occurrence, null if none; days_past_horizon: positive once past."""
    return (
        F.when((class_ == "superseded") | (F.coalesce(closure, F.lit("")) == "superseded"), F.lit(DECAY_FLOOR))
        .when(class_ == "commitment", F.when(F.coalesce(closure, F.lit("")) == "fulfilled", 0.3).otherwise(1.0))
        .when(class_ == "transient", age_decay(age, 2.0))
        .when(class_ == "decaying", age_decay(age, 60.0))
        .when(days_to_next.isNotNull(), F.when(F.abs(days_to_next) <= 14, 1.0).otherwise(0.5))
        .when(class_.isin("one_off", "periodic") & (days_past_horizon > 0), age_decay(days_past_horizon, 14.0))
        .otherwise(1.0)
    )


def temporal_relevance(factor: Column, confidence: Column) -> Column:
    c = clamp(confidence, 0.0, 1.0)
    return factor * c + (1 - c)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, 2)
