"""Extractive summaries of feedback, per group and per entity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.functions import aspects as A
from reviewlens.functions import text as T
from reviewlens.functions.grades import out_of_ten
from reviewlens.functions.literals import string_map
from reviewlens.operators.entity import summarise_groups
from reviewlens.operators.score import extract_labels
from reviewlens.operators.skew import first_per_group, lookup_join
from reviewlens.session import materialise

LOW_VOLUME = 5
_NO_TEXTS = "array<string>"
# What a group may need of its comments: the opening of the first ones, and its first long sentences.
_SENTENCES, _LONGER_THAN = 3, 20


def group_pieces(
    df: DataFrame, by: str, text: str, order: str, opening: int
) -> DataFrame:
    """Per group (blank comments make a group as well): ``words``, ``joined``, ``chosen``.

    ``chosen`` are the first three sentences of more than 20 characters,
    comment by comment; ``joined`` is all comments if they have fewer than 25
    words together, and else their first ``opening`` characters, which matters
    to groups without such a sentence only. So a comment adds three sentences
    and an opening at most, and a group the first few of each. The opening of a
    comment that has both such a sentence and 25 words is of no use to its group.
    """
    trimmed = T.text_trim(F.col(text))
    rows = df.where(F.col(by).isNotNull()).select(by, F.col(order).alias("_order"), F.coalesce(trimmed, F.lit("")).alias("_text"))
    n_words = T.words_up_to(F.col("_text"), K.SUMMARY_MIN_WORDS)
    rows = rows.withColumn("_words", n_words)
    rows = rows.withColumn("_long", F.slice(T.sentences(F.col("_text"), _LONGER_THAN), 1, _SENTENCES))
    start = (
        F.when(F.col("_words") < K.SUMMARY_MIN_WORDS, F.col("_text"))
        .when(F.size("_long") > 0, "")
        .otherwise(F.substring("_text", 1, opening))
    )
    piece = lambda kind, position, words, value: F.struct(
        F.lit(kind).alias("kind"), position.alias("position"), words.alias("words"), value.alias("piece")
    )
    first = F.array(piece(F.when(F.col("_text") == "", 0).otherwise(1), F.lit(0), F.col("_words"), start))
    longer = F.transform("_long", lambda s, i: piece(2, i, F.lit(0), s))
    spread = rows.select(by, "_order", F.explode(F.concat(first, longer)).alias("p")).select(by, "_order", "p.*")
    # With a blank between comments, half as many as there are characters fill the opening.
    most = max(_SENTENCES, K.SUMMARY_MIN_WORDS, -(-(opening + 1) // 2))
    picked = first_per_group(spread, [by, "kind"], [F.col("_order"), F.col("position")], most, "_order")
    kept = F.struct("_rank", "piece")
    grouped = picked.groupBy(by).agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == 1, kept))).alias("_openings"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == 2) & (F.col("_rank") <= _SENTENCES), kept))).alias("_sentences"),
    )
    pieces = lambda column: F.transform(column, lambda p: p["piece"])
    return grouped.select(
        by, "words", F.array_join(pieces("_openings"), " ").alias("joined"), pieces("_sentences").alias("chosen")
    )


def summarise_feedback(
    df: DataFrame, by: str | None = None, text: str = "feedback_text", order: str = "review_id", opening: int = K.SUMMARY_OPENING_CHARS
) -> DataFrame:
    """Summary of all comments, or of each group's; always one row without groups.

    Fewer than 25 words are their own summary; more give their first three
    longer sentences, or without one the first ``opening`` characters. Groups
    of blank comments have an empty summary.
    """
    key = by or "_all"
    rows = df if by else df.withColumn(key, F.lit("all"))
    groups = group_pieces(rows, key, text, order, opening)
    summary = (
        F.when(F.col("words") < K.SUMMARY_MIN_WORDS, F.col("joined"))
        .when(F.size("chosen") > 0, F.array_join("chosen", " "))
        .otherwise(F.substring("joined", 1, opening))
    )
    summaries = groups.select(key, summary.alias("summary"))
    if by:
        return summaries
    found = summaries.agg(F.max("summary").alias("summary"))
    return found.select(F.coalesce("summary", F.lit(K.NO_FEEDBACK_MESSAGE)).alias("summary"))


def summarise_by_sentiment(scored: DataFrame, text: str = "feedback_text", order: str = "review_id") -> DataFrame:
    """Summary per sentiment label; labels without feedback say so."""
    spark = scored.sparkSession
    labels = spark.createDataFrame([(s,) for s in K.SENTIMENTS], "sentiment_label string")
    summaries = summarise_feedback(scored, "sentiment_label", text, order)
    missing = F.concat(F.lit("No "), F.lower("sentiment_label"), F.lit(" feedback found."))
    return labels.join(summaries, "sentiment_label", "left").withColumn("summary", F.coalesce("summary", missing))


def top_labels(df: DataFrame, by: str, text: str = "feedback_text", order: str = "review_id") -> DataFrame:
    """Per group the number of comments and its five most frequent strength and improvement labels."""
    labelled = extract_labels(df.select(by, order, text), text).drop(text)
    return summarise_groups(labelled, by, [], order).select(by, "n", "strengths", "improvements")


def _aspect_scores(scale: float) -> list[Column]:
    return [out_of_ten(F.col(c) * F.lit(float(scale))) for c in K.SCORE_COLUMNS]


def _ordered_aspects(scores: list[Column]) -> Column:
    """Aspects by score, lowest first, ties in the given order."""
    return F.array_sort(
        F.array(
            *[
                F.struct(score.alias("score"), F.lit(i).alias("position"), F.lit(aspect).alias("aspect"))
                for i, (aspect, score) in enumerate(zip(K.ASPECTS, scores))
            ]
        )
    )


def weak_aspects(ordered: Column) -> Column:
    """Up to two lowest aspects that score 6.5 or less."""
    low = F.filter(ordered, lambda a: a["score"] <= 6.5)
    return F.transform(F.slice(low, 1, 2), lambda a: a["aspect"])


def strong_aspects(ordered: Column) -> Column:
    """Up to two highest aspects that score 7 or more."""
    high = F.filter(F.reverse(ordered), lambda a: a["score"] >= 7.0)
    return F.transform(F.slice(high, 1, 2), lambda a: a["aspect"])


def _labels_by_aspect(labels: Column, table: Mapping[str, str], scores: list[Column], best_first: bool) -> Column:
    """The three labels whose aspects score highest (or lowest); unknown labels count as 5."""
    score_of = F.create_map(*[v for a, s in zip(K.ASPECTS, scores) for v in (F.lit(a), s)])
    aspect_of = string_map(table)

    def keyed(label: Column, i: Column) -> Column:
        aspect = F.coalesce(F.try_element_at(aspect_of, label), F.lit(""))
        score = F.coalesce(F.try_element_at(score_of, aspect), F.lit(5.0))
        return F.struct((-score if best_first else score).alias("score"), i.alias("i"), label.alias("label"))

    ordered = F.array_sort(F.transform(labels, keyed))
    return F.transform(F.slice(ordered, 1, 3), lambda entry: entry["label"])


def _classified_sentences(comment: Column, strong: str, weak: str) -> Column:
    """Anonymised sentences of a comment with their class: 1 strong only, 2 weak only, 3 neither or both."""

    def searched(sentence: Column, i: Column) -> Column:
        found = A.found_keywords(F.lower(sentence), A.table_keywords(K.SENTENCE_KEYWORDS), short=True)
        return F.struct(i.alias("position"), sentence.alias("piece"), found.alias("found"))

    # Most sentences hold no keyword: nothing is compared for them.
    def mentions(entry: Column) -> Column:
        labels = F.when(F.size(entry["found"]) > 0, A.signal_labels(entry["found"], K.SENTENCE_KEYWORDS))
        return F.struct(entry["position"].alias("position"), entry["piece"].alias("piece"), labels.alias("mentioned"))

    def classified(entry: Column) -> Column:
        praised = F.arrays_overlap(entry["mentioned"], F.col(strong))
        criticised = F.arrays_overlap(entry["mentioned"], F.col(weak))
        kind = F.when(entry["mentioned"].isNull(), 3).when(praised & ~criticised, 1).when(criticised & ~praised, 2).otherwise(3)
        return F.struct(kind.alias("kind"), entry["position"].alias("position"), entry["piece"].alias("piece"))

    sentences = T.anonymous_sentences(comment, 15)
    return F.transform(F.transform(F.transform(sentences, searched), mentions), classified)


def _first_two_per_class(pieces: str) -> Column:
    def first_two(kind: int) -> Column:
        return F.slice(F.filter(pieces, lambda p: p["kind"] == kind), 1, 2)

    return F.concat(*[first_two(kind) for kind in (1, 2, 3)])


def _whole_piece(comment: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("position"), comment.alias("piece")))


def summarise_entities(
    reviews: DataFrame,
    scores: DataFrame,
    entity: str = "teacher_name",
    text: str = "feedback_text",
    order: str = "review_id",
    scale: float = 1.0,
) -> DataFrame:
    """Summary, three strengths and three improvements for every entity of ``scores``.

    ``scores`` has the entity and the five aspect columns; ``scale`` multiplies
    them first (scores above 10 are then divided by 10). Entities with fewer
    than five comments get a limited-sample summary; others get up to three
    sentences that praise strong and criticise weak aspects. Two passes over
    the reviews: one counts labels, one picks at most two sentences per class
    and review, of which each entity keeps two per class.
    """
    spread = top_labels(reviews, entity, text, order)
    entities = scores.select(entity, *K.SCORE_COLUMNS).join(spread, entity, "left")
    aspects = _aspect_scores(scale)
    entities = entities.withColumn("_ordered", _ordered_aspects(aspects))
    no_labels = F.array().cast(_NO_TEXTS)
    entities = entities.select(
        entity,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(_labels_by_aspect(F.col("strengths"), K.STRENGTH_ASPECT, aspects, True), no_labels).alias("strengths"),
        F.coalesce(_labels_by_aspect(F.col("improvements"), K.IMPROVEMENT_ASPECT, aspects, False), no_labels).alias(
            "improvements"
        ),
        strong_aspects(F.col("_ordered")).alias("strong"),
        weak_aspects(F.col("_ordered")).alias("weak"),
    )
    entities = materialise(entities, "summary-entities")

    wanted = entities.where("n > 0").select(entity, "n", F.col("n").alias("_n"), "strong", "weak")
    comments = reviews.select(entity, order, text).where(F.col(entity).isNotNull() & ~T.is_blank(F.col(text)))
    comments = lookup_join(comments, wanted, entity, "_n", F.col(order)).where(F.col("n").isNotNull())
    few = F.col("n") < LOW_VOLUME
    sentences = F.when(~few, _classified_sentences(F.col(text), "strong", "weak"))
    comments = comments.withColumn("_sentences", sentences)
    pieces = F.when(few, _whole_piece(T.anonymise(F.col(text)))).otherwise(_first_two_per_class("_sentences"))
    spread_pieces = comments.select(entity, order, F.explode(pieces).alias("p"))
    spread_pieces = spread_pieces.select(entity, order, "p.kind", "p.position", "p.piece")
    # Of whole comments there are at most four per entity, of each sentence class two are enough.
    picked = first_per_group(
        spread_pieces, [entity, "kind"], [F.col(order), F.col("position")], LOW_VOLUME - 1, order
    )

    def nth(kind: int, rank: int) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("_rank") == rank), F.col("piece")))

    picked = picked.groupBy(entity).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("_rank", "piece")))).alias("whole"),
        *[nth(kind, rank).alias(f"s{kind}{rank}") for kind in (1, 2, 3) for rank in (1, 2)],
    )
    result = entities.join(picked, entity, "left")
    combined = F.coalesce(F.array_join(F.transform("whole", lambda w: w["piece"]), " "), F.lit(""))
    limited = F.concat(
        F.lit("Based on a limited sample of "),
        F.col("n").cast("string"),
        F.lit(" reviews, feedback notes that: "),
        T.cap_words(combined, 60, 60),
    )
    chosen = F.slice(F.array_compact(F.array("s11", "s21", "s31", "s12", "s22")), 1, 3)
    selected = T.cap_words(F.array_join(chosen, " "), 75, 75)
    summary = (
        F.when(F.col("n") == 0, K.NO_COMMENTS_MESSAGE)
        .when(F.col("n") < LOW_VOLUME, T.cap_words(limited, 78, 77))
        .otherwise(T.cap_words(selected, 78, 77))
    )
    return result.select(entity, summary.alias("summary"), "strengths", "improvements")


def content_keys(
    reviews: DataFrame, entity: str = "teacher_name", text: str = "feedback_text"
) -> DataFrame:
    """Per entity a key of its comments that does not depend on their order.

    The key holds their number and the exact sums of two 60-bit parts of each
    comment's MD5; the comments themselves are never brought together.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(26,0)")

    known = reviews.where(F.col(entity).isNotNull())
    sums = known.groupBy(entity).agg(
        F.count("*").alias("n"), F.sum(part(1)).alias("first"), F.sum(part(16)).alias("second")
    )
    key = F.concat_ws("-", F.col("n").cast("string"), F.col("first").cast("string"), F.col("second").cast("string"))
    return sums.select(entity, "n", key.alias("content_key"))


def refresh_summaries(
    reviews: DataFrame,
    scores: DataFrame,
    cache: DataFrame | None,
    entity: str = "teacher_name",
    text: str = "feedback_text",
    order: str = "review_id",
    scale: float = 1.0,
) -> DataFrame:
    """Summaries with their content keys; entities whose key is in ``cache`` are not summarised again.

    Every entity of ``scores`` has a row, with or without reviews and cache.

    Write the result where the next call reads its ``cache`` from. The cache is
    used twice, so it is written to the shared folder first: one that is still
    to be computed is computed once.
    """
    keys = content_keys(reviews, entity, text)
    if cache is None:
        fresh = summarise_entities(reviews, scores, entity, text, order, scale)
        return fresh.join(keys.drop("n"), entity, "left")
    keys = materialise(keys, "content-keys")
    cache = materialise(cache.select(entity, "content_key", "summary", "strengths", "improvements"), "known-summaries")
    stale = materialise(keys.join(cache, [entity, "content_key"], "left_anti"), "stale-entities")
    flagged = lookup_join(
        reviews.select(entity, order, text), stale.withColumn("_weight", F.col("n")), entity, "_weight", F.col(order)
    )
    todo = flagged.where(F.col("content_key").isNotNull()).drop("content_key", "n")
    # Entities without reviews have no key; they get their message, as without a cache.
    silent = scores.select(entity).join(keys, entity, "left_anti")
    wanted = scores.join(stale.select(entity).unionByName(silent), entity, "left_semi")
    fresh = summarise_entities(todo, wanted, entity, text, order, scale).join(keys.drop("n"), entity, "left")
    reused = cache.join(keys.drop("n"), [entity, "content_key"], "left_semi")
    return reused.unionByName(fresh)


def executive_summary(entities: DataFrame, summaries: DataFrame, entity: str = "teacher_name") -> DataFrame:
    """A fixed text block per entity: score, grade, sentiment, top and weak aspects, summary."""
    rows = entities.join(summaries.select(entity, "summary"), entity, "left")
    ordered = _ordered_aspects([F.col(c) for c in K.SCORE_COLUMNS])

    def one_decimal(value: Column) -> Column:
        return F.format_string("%.1f", F.round(value, 1))

    def listed(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda a: F.concat(a["aspect"], F.lit(" ("), one_decimal(a["score"]), F.lit(")"))), ", ")

    highest = F.array_sort(
        F.transform(ordered, lambda a: F.struct((-a["score"]).alias("m"), a["position"], a["aspect"], a["score"]))
    )
    score = F.when(F.col("overall_score") > 10, F.col("overall_score")).otherwise(F.col("overall_score") * 10)
    line = "=" * 60
    block = F.concat(
        F.lit("EXECUTIVE SUMMARY — "), F.upper(entity), F.lit(f"\n{line}\n\nOVERALL PERFORMANCE\n  Score        : "),
        one_decimal(score), F.lit(" / 100\n  Grade        : "), F.col("grade"), F.lit("  ("), F.col("descriptor"),
        F.lit(")\n\nSENTIMENT OVERVIEW\n  Positive     : "), one_decimal(F.col("positive_pct")),
        F.lit("%\n  Neutral      : "), one_decimal(F.col("neutral_pct")),
        F.lit("%\n  Negative     : "), one_decimal(F.col("negative_pct")),
        F.lit("%\n\nKEY STRENGTHS\n  "), listed(F.slice(highest, 1, 3)),
        F.lit("\n\nAREAS FOR IMPROVEMENT\n  "), listed(F.slice(ordered, 1, 2)),
        F.lit("\n\nFEEDBACK SUMMARY\n  "), F.coalesce("summary", F.lit(K.NO_COMMENTS_MESSAGE)), F.lit(f"\n\n{line}"),
    )
    return rows.select(entity, block.alias("report"))
