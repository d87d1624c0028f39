"""Small numeric expressions: clamps, grades, bands, exact means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import AggregationConfig

_SCALE = 1_000_000


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def _first_reached(score: Column, position: int, factor: float) -> Column:
    expression = None
    for row in K.GRADES:
        reached = score >= row[0] * factor
        expression = (
            F.when(reached, row[position]) if expression is None else expression.when(reached, row[position])
        )
    return expression.otherwise(K.GRADES[-1][position])


def grade(score: Column, out_of: int = 10) -> Column:
    """Letter grade of a 0-10 or 0-100 score."""
    return _first_reached(score, 1, out_of / 10)


def descriptor(score: Column, out_of: int = 10) -> Column:
    return _first_reached(score, 2, out_of / 10)


def confidence_band(mean_confidence: Column, reviews: Column, config: AggregationConfig) -> Column:
    high = (mean_confidence >= K.CONFIDENCE_HIGH) & (reviews >= config.min_reviews_for_high_confidence)
    medium = (mean_confidence >= K.CONFIDENCE_MEDIUM) & (reviews >= config.min_reviews_for_medium_confidence)
    return F.when(high, "High").when(medium, "Medium").otherwise("Low")


def out_of_ten(score: Column) -> Column:
    """Scores above 10 are on the 0-100 scale and are divided by ten."""
    return F.when(score > 10, score / 10).otherwise(score)


def fixed_point(value: Column) -> Column:
    """A score in millionths as a whole number; NaN becomes NULL.

    Sums of whole numbers do not depend on the order of the rows, so an
    aggregate gives the same result for every partitioning. Scores up to 10 can
    be summed over 900 billion rows.
    """
    value = value.cast("double")
    return F.when(~F.isnan(value), F.floor(value * _SCALE + 0.5)).cast("bigint")


def mean_of(total: Column, count: Column) -> Column:
    """The mean behind a sum of :func:`fixed_point` values."""
    return F.when(count > 0, total.cast("double") / count / F.lit(float(_SCALE)))


def exact_avg(value: Column) -> Column:
    """Mean of values of any size; they are summed as decimals, which do not overflow."""
    point = fixed_point(value)
    return mean_of(F.sum(point.cast("decimal(19,0)")), F.count(point))


def share(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))
