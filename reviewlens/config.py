"""Typed configuration; every default comes from :mod:`reviewlens.constants`."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from reviewlens import constants as K


@dataclass(frozen=True)
class Lexicon:
    """Word lists of the rule sentiment. A word may carry a polarity and a role."""

    positive: tuple[str, ...] = K.POSITIVE_WORDS
    negative: tuple[str, ...] = K.NEGATIVE_WORDS
    negations: tuple[str, ...] = K.NEGATIONS
    intensifiers: tuple[str, ...] = K.INTENSIFIERS


@dataclass(frozen=True)
class ScoringConfig:
    """What a review is scored with.

    ``probabilities`` names an ``array<struct<label, score>>`` column with class
    probabilities; ``aspect_details`` names a map column of aspect records (as
    :func:`reviewlens.operators.vectors.score_aspect_vectors` returns). Left
    unset, the word-list rules supply both. ``deduplicate`` flags repeated texts
    in :func:`reviewlens.operators.duplicates.analyze_batch`; ``sentence_level``
    cuts texts into sentences in :func:`reviewlens.operators.vectors.text_chunks`.
    """

    lexicon: Lexicon = field(default_factory=Lexicon)
    probabilities: str | None = None
    aspect_details: str | None = None
    deduplicate: bool = True
    sentence_level: bool = True


@dataclass(frozen=True)
class AggregationConfig:
    """Weights and thresholds of the entity aggregate."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(K.ENTITY_WEIGHTS))
    min_reviews_for_high_confidence: int = K.MIN_REVIEWS_HIGH
    min_reviews_for_medium_confidence: int = K.MIN_REVIEWS_MEDIUM
    normalise: bool = True
    top_labels: int = K.MAX_LABELS

    def validate(self) -> None:
        total = sum(self.weights.values())
        if abs(total - 1.0) > 0.001:
            raise ValueError(f"Weights must sum to 1.0 (current sum = {total:.4f}).")
        unknown = set(self.weights) ^ set(K.ASPECTS)
        if unknown:
            raise ValueError(f"Weights must name exactly the five aspects; check {sorted(unknown)}.")
