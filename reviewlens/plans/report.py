"""The summary report: entity aggregate joined with summaries, ready for CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import AggregationConfig
from reviewlens.operators.entity import aggregate_from_scores
from reviewlens.operators.summary import refresh_summaries, summarise_entities

REPORT_COLUMNS = (
    "Teacher Name", "Subject", "Total Reviews", "Overall Score (0-100)", "Grade", "Descriptor",
    "Communication Score", "Subject Knowledge Score", "Engagement Score", "Responsiveness Score",
    "Assignment Quality Score", "Confidence Score", "Confidence Band", "AI Summary", "AI Strengths",
    "AI Improvements",
)


def summary_report(
    scored: DataFrame,
    cache: DataFrame | None = None,
    run_summarizer: bool = True,
    config: AggregationConfig | None = None,
    order: str = "review_id",
) -> DataFrame:
    """One row per entity with 16 named columns; scores on the 0-100 scale.

    ``cache`` is an earlier result of :func:`refresh_summaries`.
    """
    entity = "teacher_name"
    entities = aggregate_from_scores(scored, config, entity, order)
    if run_summarizer:
        if cache is None:
            summaries = summarise_entities(scored, entities, entity, order=order, scale=10.0)
        else:
            summaries = refresh_summaries(scored, entities, cache, entity, order=order, scale=10.0)
        rows = entities.join(summaries.select(
            entity, "summary", F.col("strengths").alias("_s"), F.col("improvements").alias("_i")
        ), entity, "left")
    else:
        nothing = F.array().cast("array<string>")
        rows = entities.withColumns({"summary": F.lit(K.SUMMARY_DISABLED_MESSAGE), "_s": nothing, "_i": nothing})
    values = [
        F.col(entity), F.col("subject"), F.col("total_reviews"), F.round(F.col("overall_score") * 10, 1),
        F.col("grade"), F.col("descriptor"),
        *[F.round(F.col(c) * 10, 1) for c in K.SCORE_COLUMNS],
        F.round("confidence_score", 2), F.col("confidence_band"), F.col("summary"),
        F.array_join("_s", " | "), F.array_join("_i", " | "),
    ]
    return rows.select(*[v.alias(n) for n, v in zip(REPORT_COLUMNS, values)])
