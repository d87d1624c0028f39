"""Review analytics on Spark: score free-text reviews, then aggregate, rank and report entities."""

from reviewlens.config import AggregationConfig, Lexicon, ScoringConfig
from reviewlens.operators.entity import aggregate, aggregate_from_scores
from reviewlens.operators.score import score_reviews

__all__ = [
    "AggregationConfig",
    "Lexicon",
    "ScoringConfig",
    "aggregate",
    "aggregate_from_scores",
    "score_reviews",
]
