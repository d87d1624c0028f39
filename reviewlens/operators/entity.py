"""One row per reviewed entity: means, confidence, labels, normalised scores, grade and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as types

from reviewlens import constants as K
from reviewlens.config import AggregationConfig, ScoringConfig
from reviewlens.functions import grades as G
from reviewlens.functions.text import text_trim
from reviewlens.operators.score import score_reviews
from reviewlens.operators.skew import with_rank
from reviewlens.session import materialise

ENTITY_COLUMNS = (
    "subject",
    "semester",
    "total_reviews",
    *K.SCORE_COLUMNS,
    "overall_score",
    "confidence_score",
    "confidence_band",
    "grade",
    "descriptor",
    "positive_pct",
    "neutral_pct",
    "negative_pct",
    "mixed_count",
    "strengths",
    "improvements",
)
_LISTS = {"strengths_list": "strengths", "improvements_list": "improvements"}
_MODES = ("subject", "semester")
_MEASURES = [*K.SCORE_COLUMNS, "confidence"]


def with_defaults(scored: DataFrame, entity: str = "teacher_name") -> DataFrame:
    """Add what is missing: the entity, neutral scores and a confidence of 0.5."""
    defaults: dict[str, Column] = {}
    if entity not in scored.columns:
        defaults[entity] = F.lit(K.DEFAULT_ENTITY)
    for column in K.SCORE_COLUMNS:
        if column not in scored.columns:
            defaults[column] = F.lit(K.DEFAULT_SCORE)
    if "confidence" not in scored.columns:
        defaults["confidence"] = F.lit(K.DEFAULT_CONFIDENCE)
    return scored.withColumns(defaults) if defaults else scored


def label_list(df: DataFrame, column: str) -> Column:
    """A label column as an array; ``"a | b"`` strings are split."""
    if isinstance(df.schema[column].dataType, types.ArrayType):
        return F.col(column)
    parts = F.transform(F.split(F.col(column), r"\|"), text_trim)
    return F.filter(parts, lambda label: label != "")


def _facts(df: DataFrame, modes: list[str]) -> Column:
    """What one row contributes: itself, its subject and semester, each of its labels."""

    def fact(kind: str, item: Column, position: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"), position.alias("position"))

    def spread(kind: str, labels: Column) -> Column:
        return F.transform(labels, lambda label, i: fact(kind, label, i))

    single = [fact("row", F.lit(None).cast("string"), F.lit(0))]
    single += [fact(c, F.col(c).cast("string"), F.lit(0)) for c in modes]
    lists = [F.array(*single)]
    for column, kind in _LISTS.items():
        if column in df.columns:
            labels = F.coalesce(label_list(df, column), F.array().cast("array<string>"))
            lists.append(spread(kind, labels))
    return F.filter(F.concat(*lists), lambda f: (f["kind"] == "row") | f["item"].isNotNull())


def group_state(df: DataFrame, key: str, measures: list[str], order: str = "review_id") -> DataFrame:
    """What is known of every group, as counts and sums that can be added to those of other rows.

    Every row is spread into its facts (itself, its subject and semester, each
    label) and these are counted by (group, kind, item). Rows without a group
    are left out. Stored states of several sets of rows are brought together by
    :func:`merge_states`; nothing is lost against counting all rows at once.
    """
    df = df.where(F.col(key).isNotNull())
    ordered = order in df.columns
    first = F.col(order) if ordered else F.lit(0).cast("bigint")
    modes = [c for c in _MODES if c in df.columns and c != key]
    flags: dict[str, Column] = {}
    for label in K.SENTIMENTS:
        known = "sentiment_label" in df.columns
        flags[label] = (F.col("sentiment_label") == label) if known else F.lit(False)
    flags["mixed"] = F.col("is_mixed") if "is_mixed" in df.columns else F.lit(False)

    spread = df.select(
        F.col(key),
        first.alias("_first"),
        *[G.fixed_point(F.col(m)).alias(f"_m_{m}") for m in measures],
        *[v.alias(f"_f_{n}") for n, v in flags.items()],
        F.explode(_facts(df, modes)).alias("_fact"),
    )
    of_row = F.col("_fact.kind") == "row"
    return spread.groupBy(
        key, F.col("_fact.kind").alias("kind"), F.col("_fact.item").alias("item")
    ).agg(
        F.count("*").alias("n"),
        F.min("_first").alias("first"),
        # Without an order of the rows, items that are as frequent go by their names alone.
        (F.min_by(F.col("_fact.position"), F.col("_first")) if ordered else F.min(F.lit(0))).alias("position"),
        *[F.sum(F.when(of_row, F.col(f"_m_{m}").cast("decimal(19,0)"))).alias(f"sum_{m}") for m in measures],
        *[F.count(F.when(of_row, F.col(f"_m_{m}"))).alias(f"count_{m}") for m in measures],
        *[F.count_if(of_row & F.col(f"_f_{n}")).alias(f"flag_{n}") for n in flags],
    )


def merge_states(state: DataFrame, *others: DataFrame) -> DataFrame:
    """The state of all rows behind some states of :func:`group_state`, which must be of disjoint rows.

    Counts and sums are added, the first row of an item is the smallest of the
    states' (states without an order of rows have none). Types stay, so that a
    merged state is one to merge again.
    """
    rows = state
    for other in others:
        rows = rows.unionByName(other)
    identity = [c for c in state.columns[:3]]
    added = [c for c in state.columns[3:] if c not in ("first", "position")]
    merged = rows.groupBy(*identity).agg(
        *[F.sum(c).cast(state.schema[c].dataType).alias(c) for c in added],
        F.min("first").alias("first"),
        F.min_by("position", F.struct("first", "position")).alias("position"),
    )
    return merged.select(*state.columns)


def summarise_groups(
    df: DataFrame, key: str, measures: list[str], order: str = "review_id", top: int = K.MAX_LABELS
) -> DataFrame:
    """One row per group: size, means, label counts, most frequent items; one pass over the rows.

    The most frequent subject, semester and labels are part of the same hash
    aggregate as the means (:func:`group_state`): the rows are read and scored
    once, partial sums leave each map task, and no task ever holds all rows of
    a group. Rows without a group are left out.

    Columns: the group, ``n``, ``mean_<measure>``, ``n_<label>``, ``n_mixed``,
    ``subject``, ``semester`` and the arrays ``strengths`` and ``improvements``.
    """
    return groups_from_state(group_state(df, key, measures, order), key, measures, top)


def groups_from_state(counted: DataFrame, key: str, measures: list[str], top: int = K.MAX_LABELS) -> DataFrame:
    """The rows of :func:`summarise_groups` from a state."""
    flags = [*K.SENTIMENTS, "mixed"]
    by_frequency = Window.partitionBy(key, "kind").orderBy(F.desc("n"), "first", "position", "item")
    ranked = counted.withColumn("place", F.row_number().over(by_frequency)).where(F.col("place") <= top)

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    grouped = ranked.groupBy(key).agg(
        F.max(of("row", F.col("n"))).alias("n"),
        *[F.max(of("row", F.col(f"sum_{m}"))).alias(f"sum_{m}") for m in measures],
        *[F.max(of("row", F.col(f"count_{m}"))).alias(f"count_{m}") for m in measures],
        *[F.max(of("row", F.col(f"flag_{n}"))).alias(f"n_{n}") for n in flags],
        *[F.max(F.when(F.col("place") == 1, of(c, F.col("item")))).alias(c) for c in _MODES if c != key],
        *[F.array_sort(F.collect_list(of(c, F.struct("place", "item")))).alias(c) for c in _LISTS.values()],
    )
    return grouped.select(
        key,
        "n",
        *[G.mean_of(F.col(f"sum_{m}"), F.col(f"count_{m}")).alias(f"mean_{m}") for m in measures],
        *[f"n_{n}" for n in flags],
        *[c for c in _MODES if c != key],
        *[F.transform(c, lambda s: s["item"]).alias(c) for c in _LISTS.values()],
    )


def entity_state(scored: DataFrame, entity: str = "teacher_name", order: str = "review_id") -> DataFrame:
    """Counts and sums per entity behind :func:`aggregate_from_scores`; add states with :func:`merge_states`."""
    return group_state(with_defaults(scored, entity), entity, _MEASURES, order)


def entity_means(state: DataFrame, config: AggregationConfig, entity: str) -> DataFrame:
    """Per-entity statistics before normalisation."""
    groups = groups_from_state(state, entity, _MEASURES, config.top_labels)
    mean_confidence = F.col("mean_confidence")
    volume = F.least(F.lit(1.0), F.col("n") / F.lit(float(config.min_reviews_for_high_confidence)))
    return groups.select(
        entity,
        "subject",
        "semester",
        F.col("n").alias("total_reviews"),
        *[F.round(F.round(G.clamp(F.col(f"mean_{c}"), 0, 10), 4), 2).alias(c) for c in K.SCORE_COLUMNS],
        F.round(mean_confidence * (F.lit(0.6) + F.lit(0.4) * volume), 4).alias("confidence_score"),
        G.confidence_band(mean_confidence, F.col("n"), config).alias("confidence_band"),
        *[G.share(F.col(f"n_{s}"), F.col("n")).alias(f"{s.lower()}_pct") for s in K.SENTIMENTS],
        F.col("n_mixed").alias("mixed_count"),
        *[F.array_join(c, " | ").alias(c) for c in _LISTS.values()],
    )


def _bounds(entities: DataFrame) -> Row:
    """One row: the number of entities, and lowest and highest mean per aspect."""
    return entities.agg(
        F.count("*").alias("entities"),
        *[F.min(c).alias(f"low_{c}") for c in K.SCORE_COLUMNS],
        *[F.max(c).alias(f"high_{c}") for c in K.SCORE_COLUMNS],
    ).first()


def _normalised(column: str, bounds: Row) -> Column:
    low, high = bounds[f"low_{column}"], bounds[f"high_{column}"]
    if low is None or low == high:
        return F.col(column)
    return F.round(G.clamp((F.col(column) - low) / F.lit(high - low) * 10, 0, 10), 2)


def aggregate_from_scores(
    scored: DataFrame,
    config: AggregationConfig | None = None,
    entity: str = "teacher_name",
    order: str = "review_id",
) -> DataFrame:
    """One normalised, graded and ranked row per entity.

    Aspect means are rescaled so that the best entity gets 10 and the worst 0
    (``config.normalise``). The entity table is written once before that: the
    bounds and the final table are then read from it instead of the reviews.
    Ties between labels go to the one seen first by ``order``.
    """
    return aggregate_from_state(entity_state(scored, entity, order), config, entity)


def aggregate_from_state(
    state: DataFrame, config: AggregationConfig | None = None, entity: str = "teacher_name"
) -> DataFrame:
    """The rows of :func:`aggregate_from_scores` from a state of :func:`entity_state`, stored or merged."""
    config = config or AggregationConfig()
    config.validate()
    entities = materialise(entity_means(state, config, entity), "entities")
    bounds = _bounds(entities)
    if config.normalise:
        entities = entities.withColumns({c: _normalised(c, bounds) for c in K.SCORE_COLUMNS})
    overall = F.lit(0.0)
    for aspect, column in K.SCORE_COLUMN.items():
        overall = overall + F.col(column) * F.lit(config.weights[aspect])
    entities = entities.withColumn("overall_score", F.round(G.clamp(overall, 0, 10), 2))
    entities = entities.withColumns(
        {"grade": G.grade(F.col("overall_score")), "descriptor": G.descriptor(F.col("overall_score"))}
    )
    ranked = with_rank(entities, [F.desc("overall_score"), F.asc(entity)], bounds["entities"])
    return ranked.select(entity, *ENTITY_COLUMNS, "rank")


def aggregate(
    reviews: DataFrame,
    config: AggregationConfig | None = None,
    scoring: ScoringConfig | None = None,
    entity: str = "teacher_name",
    order: str = "review_id",
) -> DataFrame:
    """Raw reviews to ranked entities."""
    (config or AggregationConfig()).validate()
    return aggregate_from_scores(score_reviews(reviews, config=scoring), config, entity, order)


def rank_entities(scores: DataFrame, entity: str = "teacher", score: str = "score") -> DataFrame:
    """Rank any entity scores, highest first, ties by name; a missing score counts as 0."""
    scores = scores.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))
    defaults = {"grade": "N/A", "descriptor": ""}
    for column, value in defaults.items():
        given = F.col(column) if column in scores.columns else F.lit(None).cast("string")
        scores = scores.withColumn(column, F.coalesce(given, F.lit(value)))
    scores = materialise(scores, "scores")
    return with_rank(scores, [F.desc(score), F.asc(entity)], scores.count())


def unpivot_aspects(entities: DataFrame) -> DataFrame:
    """Entity table from wide to long: one row per entity and aspect."""
    ids = [c for c in ("teacher_name", "overall_score", "grade", "rank") if c in entities.columns]
    long = entities.unpivot(ids, list(K.SCORE_COLUMNS), "aspect_column", "score")
    aspect = F
    for label, column in K.SCORE_COLUMN.items():
        aspect = aspect.when(F.col("aspect_column") == column, label)
    return long.withColumn("aspect", aspect).drop("aspect_column")


def entity_report(entities: DataFrame, name: str, entity: str = "teacher_name") -> DataFrame:
    """The row of one entity; no rows when it is unknown."""
    return entities.where(F.col(entity) == name).limit(1)
