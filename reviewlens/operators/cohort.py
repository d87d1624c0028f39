"""Statistics over all reviews or all entities, and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.functions import aspects as A
from reviewlens.functions import grades as G
from reviewlens.operators.entity import summarise_groups

_TITLES = {c: c.removesuffix("_score").replace("_", " ").title() for c in K.SCORE_COLUMNS}


def cohort_summary(entities: DataFrame) -> DataFrame:
    """One row of cohort statistics over a ranked entity table; no rows for an empty one."""
    overall = F.col("overall_score")
    last = F.max_by("teacher_name", "rank")
    stats = entities.agg(
        F.count("*").alias("n_teachers"),
        F.sum("total_reviews").alias("total_reviews"),
        F.round(G.exact_avg(overall), 2).alias("mean_overall"),
        F.round(F.stddev_samp(overall), 2).alias("std_overall"),
        F.round(F.median(overall), 2).alias("median_overall"),
        F.min_by("teacher_name", "rank").alias("top_teacher"),
        F.max(overall).alias("top_score"),
        last.alias("bottom_teacher"),
        F.min(overall).alias("bottom_score"),
        F.count_if(F.col("confidence_band") == "High").alias("high_confidence_count"),
        *[F.count_if(F.col("grade") == row[1]).alias(f"_grade_{i}") for i, row in enumerate(K.GRADES)],
        *[G.exact_avg(F.col(c)).alias(f"_mean_{c}") for c in K.SCORE_COLUMNS],
    ).where("n_teachers > 0")
    grades = F.array(
        *[F.struct(F.lit(row[1]).alias("grade"), F.col(f"_grade_{i}").alias("n")) for i, row in enumerate(K.GRADES)]
    )
    means = [F.col(f"_mean_{c}") for c in K.SCORE_COLUMNS]
    best, worst = F, F
    for column, mean in zip(K.SCORE_COLUMNS, means):
        best = best.when(mean == F.greatest(*means), _TITLES[column])
        worst = worst.when(mean == F.least(*means), _TITLES[column])
    stats = stats.withColumns(
        {
            "grade_distribution": F.map_from_entries(F.filter(grades, lambda g: g["n"] > 0)),
            "best_aspect": best,
            "weakest_aspect": worst,
        }
    )
    return stats.drop(*[c for c in stats.columns if c.startswith("_")])


def _label(df: DataFrame) -> Column:
    return F.coalesce(F.col("sentiment_label"), F.lit("Neutral"))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """Counts and shares per label, mean polarity and confidence, mixed texts, dominant label."""
    n = F.count("*")
    stats = scored.agg(
        n.alias("n"),
        *[F.count_if(_label(scored) == s).alias(f"{s.lower()}_count") for s in K.SENTIMENTS],
        F.round(G.exact_avg(F.coalesce("polarity", F.lit(5.0))), 4).alias("avg_polarity"),
        F.round(G.exact_avg(F.coalesce("confidence", F.lit(0.5))), 4).alias("avg_confidence"),
        F.count_if("is_mixed").alias("mixed_count"),
    )
    counts = [F.col(f"{s.lower()}_count") for s in K.SENTIMENTS]
    dominant = F
    for label, count in zip(K.SENTIMENTS, counts):
        dominant = dominant.when(count == F.greatest(*counts), label)
    return stats.select(
        *[c for c in counts],
        *[G.share(c, F.col("n")).alias(f"{s.lower()}_pct") for s, c in zip(K.SENTIMENTS, counts)],
        F.coalesce("avg_polarity", F.lit(0.0)).alias("avg_polarity"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        "mixed_count",
        dominant.alias("overall"),
    )


def batch_summary(scored: DataFrame, by: str | None = None, order: str = "review_id") -> DataFrame:
    """Mean scores, top labels, grade and sentiment shares of all reviews or per group."""
    key = by or "_all"
    rows = scored if by else scored.withColumn(key, F.lit("all"))
    measures = ["overall_score", *K.SCORE_COLUMNS, "confidence"]
    groups = summarise_groups(rows, key, measures, order)
    means = {m: F.round(F.coalesce(f"mean_{m}", F.lit(0.0)), 2) for m in measures}
    score = means["overall_score"] * 10
    return groups.select(
        *([by] if by else []),
        *[v.alias(m) for m, v in means.items()],
        "strengths",
        "improvements",
        G.grade(score, 100).alias("grade"),
        G.descriptor(score, 100).alias("descriptor"),
        F.col("n").alias("n_feedback"),
        *[G.share(F.col(f"n_{s}"), F.col("n")).alias(f"{s.lower()}_pct") for s in K.SENTIMENTS],
    )


def entity_score(scored: DataFrame, by: str | None = "teacher_name", use_aspects: bool = True) -> DataFrame:
    """Scores on the 0-100 scale from ``polarity`` and, with ``use_aspects``, ``aspect_detail``.

    Without a group there is always one row; for no reviews it says "N/A".
    """
    polarity = F.coalesce("polarity", F.lit(5.0))
    aspects: dict[str, Column] = {}
    if use_aspects:
        for aspect, column in K.SCORE_COLUMN.items():
            blended = A.blended_score(aspect, "coalesce(polarity, 5.0D)")
            aspects[column] = F.round(G.exact_avg(blended * 10), 2)
    rows = scored.where(F.col(by).isNotNull()) if by else scored
    grouped = rows.groupBy(by) if by else rows.groupBy()
    stats = grouped.agg(
        F.count("*").alias("n"),
        (G.exact_avg(polarity) * 10).alias("_polarity"),
        *[v.alias(c) for c, v in aspects.items()],
        *[F.count_if(_label(scored) == s).alias(f"_n_{s}") for s in K.SENTIMENTS],
    )
    overall = F.col("_polarity")
    if use_aspects:
        overall = F.lit(0.0)
        for aspect, column in K.SCORE_COLUMN.items():
            overall = overall + F.col(column) * F.lit(K.REVIEW_WEIGHTS[aspect])
    stats = stats.withColumn("overall_score", F.round(G.clamp(F.coalesce(overall, F.lit(0.0)), 0, 100), 2))
    some = F.col("n") > 0
    return stats.select(
        *([by] if by else []),
        "overall_score",
        F.when(some, G.grade(F.col("overall_score"), 100)).otherwise("N/A").alias("grade"),
        F.when(some, G.descriptor(F.col("overall_score"), 100)).otherwise("No data").alias("descriptor"),
        *aspects,
        *[G.share(F.col(f"_n_{s}"), F.col("n")).alias(f"{s.lower()}_pct") for s in K.SENTIMENTS],
    )


def aspect_frequency(detected: DataFrame, column: str = "aspects") -> DataFrame:
    """Mentions per aspect; the eight dashboard aspects are listed even without any."""
    spark = detected.sparkSession
    listed = spark.createDataFrame([(a, 0) for a in K.DASHBOARD_ASPECTS], "aspect string, mentions bigint")
    names = F.transform(column, lambda found: found["aspect"])
    mentioned = detected.select(F.explode(names).alias("aspect"))
    counted = mentioned.groupBy("aspect").agg(F.count("*").alias("mentions"))
    return counted.unionByName(listed).groupBy("aspect").agg(F.sum("mentions").alias("mentions"))


def score_bins(scores: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins on [0, 100], the last one closed; values outside are left out."""
    spark = scores.sparkSession
    value = F.col(column).cast("double")
    inside = scores.where(value.between(0, 100))
    bucket = F.least(F.width_bucket(value, F.lit(0.0), F.lit(100.0), F.lit(bins)), F.lit(bins)).cast("bigint")
    counted = inside.groupBy(bucket.alias("bin")).agg(F.count("*").alias("count"))
    empty = spark.range(1, bins + 1).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("count"))
    width = F.lit(100.0 / bins)
    return (
        counted.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("count").alias("count"))
        .select("bin", ((F.col("bin") - 1) * width).alias("low"), (F.col("bin") * width).alias("high"), "count")
    )


def review_volume(reviews: DataFrame, entity: str = "teacher_name") -> DataFrame:
    """Number of reviews per entity, most first."""
    counted = reviews.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("feedback_count"))
    return counted.orderBy(F.desc("feedback_count"), entity)


def sentiment_counts(scored: DataFrame, by: str | None = None) -> DataFrame:
    keys = ([by] if by else []) + ["sentiment_label"]
    return scored.where(F.col("sentiment_label").isNotNull()).groupBy(*keys).agg(F.count("*").alias("count"))


def sentiment_crosstab(scored: DataFrame, entity: str = "teacher_name") -> DataFrame:
    """One row per entity with the number of reviews of each label."""
    known = scored.where(F.col(entity).isNotNull() & F.col("sentiment_label").isNotNull())
    counts = known.groupBy(entity).pivot("sentiment_label", list(K.SENTIMENTS)).count()
    return counts.na.fill(0, list(K.SENTIMENTS))


def key_figures(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: reviews, label shares, mean overall score and grade on the 0-100 scale."""
    reviews = scored.agg(
        F.count("*").alias("total_reviews"),
        *[F.count_if(F.col("sentiment_label") == s).alias(f"_n_{s}") for s in K.SENTIMENTS],
    )
    mean = entities.agg(F.round(G.exact_avg(F.col("overall_score")), 2)).scalar()
    score = F.coalesce(F.col("_mean"), F.lit(0.0)) * 10
    total = F.col("total_reviews")
    return reviews.withColumn("_mean", mean).select(
        "total_reviews",
        *[G.share(F.col(f"_n_{s}"), total).alias(f"{s.lower()}_pct") for s in K.SENTIMENTS],
        score.alias("overall_score"),
        G.grade(score, 100).alias("grade"),
    )


def aspect_averages(entities: DataFrame) -> DataFrame:
    """Mean of each aspect over the entities, on the 0-100 scale."""
    means = entities.agg(*[(G.exact_avg(F.col(c)) * 10).alias(a) for a, c in K.SCORE_COLUMN.items()])
    return means.unpivot([], list(K.ASPECTS), "aspect", "score")
