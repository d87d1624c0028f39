"""Repeated texts: fingerprints, first occurrences, scoring each distinct text once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import ScoringConfig
from reviewlens.functions import text as T
from reviewlens.operators.score import DETAIL_COLUMNS, SCORED_COLUMNS, score_reviews
from reviewlens.operators.skew import lookup_join
from reviewlens.session import materialise


def with_fingerprint(df: DataFrame, text: str = "feedback_text") -> DataFrame:
    """Add ``fingerprint``; blank texts have none."""
    value = F.when(~T.is_blank(F.col(text)), T.fingerprint(F.col(text)))
    return df.withColumn("fingerprint", value)


def mark_duplicates(df: DataFrame, text: str = "feedback_text", order: str = "review_id") -> DataFrame:
    """Add ``fingerprint`` and ``is_duplicate``: false for the first text by ``order`` and for blanks.

    Only repeated fingerprints take part in the join back, and heavily repeated
    ones are matched without a shuffle (see :func:`lookup_join`).
    """
    df = with_fingerprint(df, text)
    groups = df.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint")
    repeated = groups.agg(F.min(order).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    joined = lookup_join(df, materialise(repeated, "repeated"), "fingerprint", "_copies", F.col(order))
    later = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return joined.withColumn("is_duplicate", later).drop("_first")


def distinct_texts(df: DataFrame, text: str = "feedback_text", fold_case: bool = True) -> DataFrame:
    """One row per distinct text: first ``review_id`` and number of copies.

    With ``fold_case`` texts that differ only in case or outer white space are
    one text; without, the comparison is exact.
    """
    key = F.lower(T.text_trim(F.col(text))) if fold_case else F.col(text)
    kept = df.where(~T.is_blank(F.col(text)))
    groups = kept.groupBy(key.alias(text))
    return groups.agg(F.min("review_id").alias("review_id"), F.count("*").alias("copies"))


def score_distinct(
    df: DataFrame, text: str = "feedback_text", order: str = "review_id", config: ScoringConfig | None = None
) -> DataFrame:
    """Score each distinct text once and give the result to all of its copies.

    Equal to :func:`score_reviews` if a score depends on the trimmed lower-case
    text alone; worth its joins when scoring costs more than they do. Columns
    that the configuration names (class probabilities, aspect records) are those
    of the first copy by ``order``.
    """
    config = config or ScoringConfig()
    given = [c for c in (config.probabilities, config.aspect_details) if c]
    lowered = F.lower(T.text_trim(F.col(text)))
    copies = [F.count("*").alias("_copies")]
    if given:
        copies.append(F.min_by(F.struct(*given), F.col(order)).alias("_given"))
    distinct = df.where(~T.is_blank(F.col(text))).groupBy(lowered.alias(text)).agg(*copies)
    distinct = distinct.select(text, "_copies", *[F.col(f"_given.{c}").alias(c) for c in given])
    distinct = with_fingerprint(distinct, text)
    scored = score_reviews(distinct, text, config)
    scored = materialise(scored.select("fingerprint", "_copies", *SCORED_COLUMNS), "distinct-scores")
    df = df.drop(*[c for c in SCORED_COLUMNS + DETAIL_COLUMNS if c in df.columns])
    joined = lookup_join(with_fingerprint(df, text), scored, "fingerprint", "_copies", F.col(order))
    blanks = {c: F.lit(0.0) for c in ("overall_score", *K.SCORE_COLUMNS, "confidence")}
    blanks["sentiment_label"] = F.lit("Neutral")
    blanks["is_mixed"] = F.lit(False)
    for column in ("strengths_list", "improvements_list"):
        blanks[column] = F.array().cast("array<string>")
    filled = {c: F.coalesce(F.col(c), value) for c, value in blanks.items()}
    return joined.withColumns(filled).drop("fingerprint")


def analyze_batch(
    df: DataFrame,
    text: str = "feedback_text",
    order: str = "review_id",
    config: ScoringConfig | None = None,
    details: bool = True,
) -> DataFrame:
    """The full record of every review: its scores, and ``is_duplicate`` unless it is the first with its text.

    With ``deduplicate`` off in the configuration no text counts as a
    duplicate, and nothing is compared.
    """
    config = config or ScoringConfig()
    scored = score_reviews(df.drop("is_duplicate"), text, config, details)
    if not config.deduplicate:
        return scored.withColumn("is_duplicate", F.lit(False))
    return mark_duplicates(scored, text, order).drop("fingerprint")
