"""Tables that a stream of reviews keeps up to date: the state of the entities, their summaries, their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlens.config import AggregationConfig
from reviewlens.operators.entity import aggregate_from_state, entity_state, merge_states
from reviewlens.operators.summary import refresh_summaries
from reviewlens.sources.versions import last_version, read_version, write_version


def add_reviews(
    scored: DataFrame, path: str, entity: str = "teacher_name", order: str = "review_id", version: int | None = None
) -> DataFrame:
    """Add scored reviews to the stored state of their entities, as a new version; returns the state.

    Only the new reviews and the state are read. With the number of a batch as
    ``version`` a repeated batch is not counted twice.
    """
    spark = scored.sparkSession
    last = last_version(spark, path)
    state = entity_state(scored, entity, order)
    if last is not None and (version is None or version > last):
        state = merge_states(read_version(spark, path, last), state)
    return write_version(state, path, version)


def store_summaries(
    reviews: DataFrame,
    scores: DataFrame,
    path: str,
    entity: str = "teacher_name",
    text: str = "feedback_text",
    order: str = "review_id",
    scale: float = 1.0,
    version: int | None = None,
) -> DataFrame:
    """Refresh the stored summaries, as a new version: only entities whose comments changed are summarised.

    ``reviews`` are all reviews so far. ``since`` is the version in which an
    entity's summary was made.
    """
    spark = reviews.sparkSession
    last = last_version(spark, path)
    version = (0 if last is None else last + 1) if version is None else version
    if last is not None and version <= last:
        return read_version(spark, path, version)
    cache = read_version(spark, path, last)
    fresh = refresh_summaries(reviews, scores, cache, entity, text, order, scale)
    if cache is None:
        dated = fresh.withColumn("since", F.lit(version).cast("bigint"))
    else:
        # Entity-sized on both sides. Entities without comments have no key and are made anew.
        known = cache.select(entity, "content_key", F.col("since").alias("_since"))
        dated = fresh.join(known, [entity, "content_key"], "left")
        dated = dated.withColumn("since", F.coalesce("_since", F.lit(version).cast("bigint"))).drop("_since")
    return write_version(dated.select(entity, "content_key", "summary", "strengths", "improvements", "since"), path, version)


def keep_entities(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    entity: str = "teacher_name",
    text: str = "feedback_text",
    order: str = "review_id",
    scale: float = 10.0,
    config: AggregationConfig | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Keep state, aggregate and summaries of a stream of scored reviews under ``path``.

    ``path/state``, ``path/entities`` and ``path/summaries`` get a version per
    batch (see :func:`reviewlens.sources.versions.read_version`), and
    ``path/reviews`` the comments, a folder per batch. A batch that runs again after a failure replaces what
    it wrote, and counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(order, entity, text).write.mode("overwrite").parquet(f"{path}/reviews/batch={number}")
        state = add_reviews(batch, f"{path}/state", entity, order, number)
        ranked = write_version(aggregate_from_state(state, config, entity), f"{path}/entities", number)
        reviews = spark.read.parquet(f"{path}/reviews").where(F.col("batch") <= number).drop("batch")
        store_summaries(reviews, ranked, f"{path}/summaries", entity, text, order, scale, number)

    writer = scored.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_windows(stats: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write windows as they change instead of when they close, so that open ones are known as well.

    ``stats`` is :func:`reviewlens.streaming.reviews.windowed_entities` of a
    stream, whose state stays bounded by its watermark. Every batch writes the
    windows it changed to a folder of its own, replaced if the batch runs again.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stats.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_windows(spark: SparkSession, path: str, entity: str = "teacher_name") -> DataFrame:
    """The last state of every window that :func:`write_windows` wrote, open or closed."""
    rows = spark.read.parquet(path)
    newest = Window.partitionBy("window_start", entity).orderBy(F.desc("batch"))
    return rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place", "batch")
