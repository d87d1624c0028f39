"""The review operators on streams: scoring, dropping or flagging repeats, windowed entity statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as types
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reviewlens import constants as K
from reviewlens.config import ScoringConfig
from reviewlens.functions import grades as G
from reviewlens.operators.duplicates import with_fingerprint
from reviewlens.operators.score import score_reviews


def score_stream(reviews: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """Scoring keeps no state, so a stream is scored like a table."""
    return score_reviews(reviews, config=config)


def drop_repeats(reviews: DataFrame, time: str = "date", delay: str = "1 day", text: str = "feedback_text") -> DataFrame:
    """Drop texts seen before within the watermark delay; the state is bounded by it."""
    known = with_fingerprint(reviews, text).where(F.col("fingerprint").isNotNull())
    return known.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def flag_repeats(
    reviews: DataFrame,
    time: str = "date",
    delay: str = "1 day",
    text: str = "feedback_text",
    order: str = "review_id",
    groups: int = 1024,
) -> DataFrame:
    """Flag repeated texts instead of dropping them: ``order``, ``time``, ``fingerprint``, ``is_duplicate``.

    What is known of a fingerprint is the id that had it first and the time it
    was last seen; it is forgotten when the watermark is more than ``delay``
    past that, and the next such text is a first one again. Of the rows in which
    a text first appears the smallest id is the first, and comes without the
    flag as often as it is delivered; blank texts are never duplicates. Inside
    the watermark this equals :func:`reviewlens.operators.duplicates.mark_duplicates`
    if ids come in order. Rows behind the watermark and rows without a time are
    left out, as by all operators with a watermark.

    Fingerprints are dealt by hash to ``groups`` groups with one state each, so
    that Python is called per group and not per text. The rows of a group pass as
    a stream of narrow columns, of which one row per new text is held. A stream
    keeps the number of groups it was started with.
    """
    spark = reviews.sparkSession
    life = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {delay}"))).first()[0]
    rows = with_fingerprint(reviews, text).select(order, time, "fingerprint", F.unix_millis(time).alias("_ms"))
    rows = rows.withWatermark(time, delay)
    # Blank texts have no state; they are only spread over the groups.
    dealt = F.coalesce("fingerprint", F.col(order).cast("string"), F.lit(""))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(dealt), F.lit(groups)))
    kept = [order, time, "fingerprint"]

    def flag(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        texts, firsts, latest = state.get if state.exists else ([], [], [])
        watermark = state.getCurrentWatermarkMs()
        alive = [i for i, last in enumerate(latest) if last + life >= watermark]
        texts, firsts = [texts[i] for i in alive], [firsts[i] for i in alive]
        known, first = pd.Index(texts, dtype=object), pd.Series(firsts)
        last = np.array([latest[i] for i in alive], dtype="int64")
        held = None
        for part in parts:
            blank = part["fingerprint"].isna()
            if blank.any():
                yield part.loc[blank, kept].assign(is_duplicate=False)
                part = part[~blank]
            place = known.get_indexer(part["fingerprint"])
            old, place = part[place >= 0], place[place >= 0]
            if len(old):
                np.maximum.at(last, place, old["_ms"].to_numpy())
                again = old[order].reset_index(drop=True) != first.iloc[place].reset_index(drop=True)
                yield old[kept].assign(is_duplicate=again.to_numpy())
            if len(old) == len(part):
                continue
            part = part.drop(old.index)
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            by_text = held.groupby("fingerprint", sort=False)
            held = held.assign(_ms=by_text["_ms"].transform("max"))
            is_first = held[order] == by_text[order].transform("min")
            if not is_first.all():
                yield held.loc[~is_first, kept].assign(is_duplicate=True)
                held = held[is_first]
        if held is not None:
            yield held[kept].assign(is_duplicate=False)
            held = held.drop_duplicates("fingerprint")
            texts += held["fingerprint"].tolist()
            firsts += [v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in held[order].tolist()]
            last = np.concatenate([last, held["_ms"].to_numpy()])
        if texts:
            state.update((texts, firsts, last.tolist()))
            # By then all texts of the group are too old; those that are so earlier go when the group has rows again.
            state.setTimeoutTimestamp(int(last.max()) + life)
        elif state.exists:
            state.remove()

    result = types.StructType([*[rows.schema[c] for c in kept], types.StructField("is_duplicate", types.BooleanType())])
    columns = {"texts": types.StringType(), "firsts": rows.schema[order].dataType, "latest": types.LongType()}
    known = types.StructType([types.StructField(c, types.ArrayType(kind)) for c, kind in columns.items()])
    return rows.groupBy("_group").applyInPandasWithState(flag, result, known, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_entities(
    scored: DataFrame, window: str = "30 days", delay: str = "1 day", time: str = "date", entity: str = "teacher_name"
) -> DataFrame:
    """Per time window and entity: reviews, mean scores, confidence, label shares, mixed reviews.

    In append mode a window is written when the watermark has passed it;
    :func:`reviewlens.streaming.tables.write_windows` also writes open ones.
    """
    n = F.count("*")
    stats = (
        scored.where(F.col(entity).isNotNull())
        .withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("window"), entity)
        .agg(
            n.alias("total_reviews"),
            *[F.round(G.exact_avg(F.col(c)), 2).alias(c) for c in K.SCORE_COLUMNS],
            F.round(G.exact_avg(F.col("confidence")), 4).alias("confidence"),
            *[G.share(F.count_if(F.col("sentiment_label") == s), n).alias(f"{s.lower()}_pct") for s in K.SENTIMENTS],
            F.count_if("is_mixed").alias("mixed_count"),
        )
    )
    return stats.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *stats.columns[1:])
