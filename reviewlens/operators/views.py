"""Filters, projections and slices of the scored and entity tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.operators.skew import first_per_group

EXPLORER_COLUMNS = (
    "teacher_name", "subject", "date", "rating", "feedback_text", "sentiment_label", "sentiment_score",
)
RANKING_COLUMNS = (
    "rank", "teacher_name", "subject", "total_reviews", "overall_score", "grade", "confidence_band",
    "strengths", "improvements",
)


def filter_reviews(df: DataFrame, selected: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Keep rows whose value is selected, for every column that exists and has a selection."""
    for column, values in selected.items():
        if column in df.columns and values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def explorer(df: DataFrame, rows: int = 50, order: str = "review_id") -> DataFrame:
    """The first rows with the columns of the explorer that exist."""
    columns = [c for c in EXPLORER_COLUMNS if c in df.columns]
    return df.orderBy(order).limit(rows).select(*columns)


def first_comments(df: DataFrame, rows: int, entity: str = "teacher_name", order: str = "review_id") -> DataFrame:
    """The first comments of every entity (eight in the detail view, five in the report)."""
    known = df.where(F.col(entity).isNotNull())
    return first_per_group(known, [entity], [F.col(order)], rows, order).drop("_rank")


def head(df: DataFrame, rows: int, order: str = "review_id") -> DataFrame:
    """The first rows in order."""
    return df.orderBy(order).limit(rows)


def ranking_table(entities: DataFrame) -> DataFrame:
    """The columns of the ranking that exist, with display names."""
    columns = [c for c in RANKING_COLUMNS if c in entities.columns]
    return entities.select(*[F.col(c).alias(c.replace("_", " ").title()) for c in columns])


def aspect_bars(entities: DataFrame) -> DataFrame:
    """Aspect scores of every entity on the 0-100 scale, best first."""
    scores = entities.select("teacher_name", *[(F.col(c) * 10).alias(a) for a, c in K.SCORE_COLUMN.items()])
    long = scores.unpivot(["teacher_name"], list(K.ASPECTS), "aspect", "score")
    return long.orderBy("teacher_name", F.desc("score"), "aspect")
