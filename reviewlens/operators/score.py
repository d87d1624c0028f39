"""Score reviews: text in, sentiment, aspect scores and labels out. One narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import ScoringConfig
from reviewlens.functions import aspects as A
from reviewlens.functions import sentiment as S
from reviewlens.functions import text as T
from reviewlens.functions.grades import clamp
from reviewlens.functions.literals import sql_map

LABEL_COLUMNS = ("strengths_list", "improvements_list")
SCORED_COLUMNS = (
    "overall_score",
    *K.SCORE_COLUMNS,
    "confidence",
    "sentiment_label",
    "is_mixed",
    *LABEL_COLUMNS,
)
DETAIL_COLUMNS = ("sentiment_probs", "polarity", "aspect_detail")
DETAIL_TYPE = (
    "map<string,struct<score_10:double,relevance:double,positive_sim:double,"
    "negative_sim:double,detected:boolean>>"
)


def with_rule_aspects(df: DataFrame, found: str, column: str = "aspect_detail") -> DataFrame:
    """Add the map aspect -> record from the keywords found in each text."""
    counts = {}
    for i, aspect in enumerate(K.ASPECTS):
        positive, negative = K.ASPECT_KEYWORDS[aspect]
        counts[f"_p{i}"] = A.count_found(F.col(found), positive)
        counts[f"_n{i}"] = A.count_found(F.col(found), negative)
    df = df.withColumns(counts)
    records = {aspect: A.aspect_record(f"_p{i}", f"_n{i}") for i, aspect in enumerate(K.ASPECTS)}
    return df.withColumn(column, sql_map(records).cast(DETAIL_TYPE)).drop(*counts)


def _inferred(ordered: Column, reached: Column) -> Column:
    """One aspect name in a list, or an empty list."""
    return F.when(reached, F.array(F.lower(ordered))).otherwise(F.array().cast("array<string>"))


def _merged(signals: Column, inferred: Column, phrases: Column) -> Column:
    first = F.slice(F.when(F.size(signals) > 0, signals).otherwise(inferred), 1, K.MAX_LABELS)
    return F.slice(F.array_distinct(F.concat(first, phrases)), 1, K.MAX_LABELS)


def score_reviews(
    df: DataFrame,
    text: str = "feedback_text",
    config: ScoringConfig | None = None,
    details: bool = False,
) -> DataFrame:
    """Attach the score columns to every review.

    Score columns that ``df`` has already are replaced. Blank texts get zeros,
    ``Neutral`` and empty lists. ``details`` also keeps ``sentiment_probs``,
    ``polarity`` and ``aspect_detail``. Nothing is shuffled, so the same call
    works on a stream and filters on the given columns reach the scan.
    """
    if text not in df.columns:
        raise ValueError(f"DataFrame must contain a '{text}' column.")
    config = config or ScoringConfig()
    own_inputs = {c for c in (config.probabilities, config.aspect_details, text) if c}
    clashes = [c for c in SCORED_COLUMNS + DETAIL_COLUMNS if c in df.columns and c not in own_inputs]
    df = df.drop(*clashes)
    kept = list(df.columns)

    df = df.withColumn("_low", F.lower(T.text_trim(F.col(text))))
    df = df.withColumn("_found", A.found_keywords(F.col("_low"), A.rule_keywords()))

    if config.probabilities:
        df = S.with_probability_sentiment(df, config.probabilities)
    else:
        df = S.with_rule_sentiment(df, "_low", config.lexicon)
    if config.aspect_details:
        df = df.withColumn("aspect_detail", F.col(config.aspect_details))
    else:
        df = with_rule_aspects(df, "_found")

    df = df.withColumns({f"_b{i}": A.blended_score(aspect, "polarity") for i, aspect in enumerate(K.ASPECTS)})
    blended = [F.col(f"_b{i}") for i in range(len(K.ASPECTS))]
    overall = F.lit(0.0)
    best, worst = F, F
    top, bottom = F.greatest(*blended), F.least(*blended)
    for aspect, value in zip(K.ASPECTS, blended):
        overall = overall + value * F.lit(K.REVIEW_WEIGHTS[aspect])
        best = best.when(value == top, aspect)
        worst = worst.when(value == bottom, aspect)
    df = df.withColumns(
        {
            "overall_score": F.round(clamp(overall, 0, 10), 2),
            "_best": _inferred(best, top >= K.INFER_STRENGTH_FROM),
            "_worst": _inferred(worst, bottom < K.INFER_IMPROVEMENT_BELOW),
            "_strengths": A.signal_labels(F.col("_found"), K.STRENGTH_SIGNALS),
            "_improvements": A.signal_labels(F.col("_found"), K.IMPROVEMENT_SIGNALS),
            "_strength_phrases": A.phrase_labels(F.col("_found"), K.STRENGTH_PHRASES),
            "_improvement_phrases": A.phrase_labels(F.col("_found"), K.IMPROVEMENT_PHRASES),
        }
    )
    df = df.withColumns(
        {
            "strengths_list": _merged(F.col("_strengths"), F.col("_best"), F.col("_strength_phrases")),
            "improvements_list": _merged(F.col("_improvements"), F.col("_worst"), F.col("_improvement_phrases")),
        }
    )

    filled = F.coalesce(F.col("_low") != "", F.lit(False))
    no_labels = F.array().cast("array<string>")

    def unless_blank(value: Column, blank: Column) -> Column:
        return F.when(filled, value).otherwise(blank)

    output = {"overall_score": unless_blank(F.col("overall_score"), F.lit(0.0))}
    for i, column in enumerate(K.SCORE_COLUMNS):
        output[column] = unless_blank(F.round(blended[i], 2), F.lit(0.0))
    output["confidence"] = unless_blank(F.round("confidence", 4), F.lit(0.0))
    output["sentiment_label"] = unless_blank(F.col("sentiment_label"), F.lit("Neutral"))
    output["is_mixed"] = unless_blank(F.col("is_mixed"), F.lit(False))
    for column in LABEL_COLUMNS:
        output[column] = unless_blank(F.col(column), no_labels)
    if details:
        blank_probs = F.struct(F.lit(0.0).alias("Positive"), F.lit(1.0).alias("Neutral"), F.lit(0.0).alias("Negative"))
        output["sentiment_probs"] = unless_blank(F.col("sentiment_probs"), blank_probs)
        output["polarity"] = unless_blank(F.col("polarity"), F.lit(5.0))
        output["aspect_detail"] = unless_blank(
            F.col("aspect_detail"), F.map_from_arrays(F.array(), F.array()).cast(DETAIL_TYPE)
        )
    return df.select(*[F.col(c) for c in kept if c not in output], *[v.alias(n) for n, v in output.items()])


def detect_aspects(
    df: DataFrame,
    text: str = "feedback_text",
    top_k: int = K.DETECT_TOP_K,
    threshold: float = K.DETECT_THRESHOLD,
) -> DataFrame:
    """Add ``aspects``: the top aspects mentioned in each text, by keywords."""
    df = df.withColumn("_low", F.lower(F.col(text)))
    return df.withColumn("aspects", A.detect_by_keywords(F.col("_low"), top_k, threshold)).drop("_low")


def extract_labels(df: DataFrame, text: str = "feedback_text") -> DataFrame:
    """Add ``strengths_list`` and ``improvements_list`` from the phrase tables alone."""
    found = A.found_keywords(F.lower(F.col(text)), A.phrase_keywords())
    df = df.withColumn("_found", found)
    return df.withColumns(
        {
            "strengths_list": A.phrase_labels(F.col("_found"), K.STRENGTH_PHRASES),
            "improvements_list": A.phrase_labels(F.col("_found"), K.IMPROVEMENT_PHRASES),
        }
    ).drop("_found")
