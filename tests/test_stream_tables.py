"""Tables that streams keep: mergeable states, versions, summaries of changed entities, open windows, flags."""

import pytest
from pyspark.sql import functions as F

from reviewlens.operators.duplicates import mark_duplicates
from reviewlens.operators.entity import aggregate_from_scores, aggregate_from_state, entity_state, merge_states
from reviewlens.operators.score import score_reviews
from reviewlens.operators.summary import summarise_entities
from reviewlens.sources.versions import last_version, read_version, write_version
from reviewlens.streaming import reviews as stream
from reviewlens.streaming import tables

SCHEMA = "review_id bigint, teacher_name string, feedback_text string, subject string, date timestamp"
TEXTS = (
    "Great clear lectures and deep knowledge of the field.", "Boring and late, the pace was too fast for most of us.", "",
    "Very helpful office hours. The assignments were useful and fair.", "Not good, the grading is harsh and slow.", None,
)


def table(spark, n=60):
    rows = [(i, f"t{i % 4}" if i % 11 else None, TEXTS[i * 7 % 6], "xyz"[i % 3], f"2024-0{1 + i // 20}-{1 + i % 20:02} 10:00:00") for i in range(n)]
    df = spark.createDataFrame(rows, "review_id bigint, teacher_name string, feedback_text string, subject string, date string")
    return df.withColumn("date", F.col("date").cast("timestamp"))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def feed(df, path, conditions):
    for condition in conditions:
        df.where(condition).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_states_add_up(spark):
    scored = score_reviews(table(spark))
    parts = [entity_state(scored.where(F.pmod("review_id", F.lit(3)) == i)) for i in (2, 0, 1)]
    empty = entity_state(scored.where("false"))
    whole = aggregate_from_scores(scored)
    merged = merge_states(parts[0], merge_states(parts[1], empty, parts[2]))
    assert merged.dtypes == parts[0].dtypes
    assert rows_of(aggregate_from_state(merged)) == rows_of(whole)
    assert rows_of(merged) == rows_of(entity_state(scored))


def test_states_without_an_order_of_rows(spark):
    scored = score_reviews(table(spark)).drop("review_id")
    halves = [entity_state(scored.where(F.col("subject") == "x")), entity_state(scored.where("subject <> 'x'"))]
    assert rows_of(aggregate_from_state(merge_states(*halves))) == rows_of(aggregate_from_scores(scored))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert last_version(spark, path) is None and read_version(spark, path) is None
    write_version(spark.range(2), path)
    write_version(read_version(spark, path).unionAll(spark.range(5, 6)), path)
    assert last_version(spark, path) == 1 and read_version(spark, path).count() == 3 and read_version(spark, path, 0).count() == 2
    # Again with a number in the log: nothing changes. A version that is not in the log is not read.
    assert write_version(spark.range(9), path, 1).count() == 3
    spark.range(9).write.parquet(f"{path}/version=2")
    assert read_version(spark, path).count() == 3
    assert write_version(spark.range(4), path, 2).count() == 4 and last_version(spark, path) == 2


def test_only_changed_entities_are_summarised(spark, tmp_path):
    path, df = str(tmp_path / "s"), table(spark)
    scores = aggregate_from_scores(score_reviews(df))
    late = (F.col("teacher_name") == "t1") & (F.col("review_id") > 30)
    tables.store_summaries(df.where(~F.coalesce(late, F.lit(False))), scores, path)
    after = tables.store_summaries(df, scores, path)
    assert {r["teacher_name"]: r["since"] for r in after.collect()} == {"t0": 0, "t1": 1, "t2": 0, "t3": 0}
    plain = summarise_entities(df, scores)
    assert rows_of(after.select(*plain.columns)) == rows_of(plain)
    # Nothing new: nothing is made again. A version that was written is not written again.
    assert {r["since"] for r in tables.store_summaries(df, scores, path).collect()} == {0, 1}
    assert rows_of(tables.store_summaries(df.limit(1), scores, path, version=1)) == rows_of(after)


def test_stream_keeps_entities_and_repeats_no_batch(spark, tmp_path):
    df, inbox, out = table(spark), str(tmp_path / "in"), str(tmp_path / "out")
    feed(df, inbox, ["review_id < 25", "review_id between 25 and 40"])
    live = score_reviews(source(spark, inbox))
    tables.keep_entities(live, out, str(tmp_path / "state")).awaitTermination()
    feed(df, inbox, ["review_id > 40"])
    tables.keep_entities(live, out, str(tmp_path / "state")).awaitTermination()
    ranked = aggregate_from_scores(score_reviews(df))
    assert last_version(spark, f"{out}/state") == 2
    assert rows_of(read_version(spark, f"{out}/entities")) == rows_of(ranked)
    made = read_version(spark, f"{out}/summaries").select("teacher_name", "strengths", "improvements", "summary")
    assert {r["teacher_name"] for r in made.collect()} == {r["teacher_name"] for r in ranked.collect()}
    # The last batch once more, as after a failure between its tables and the stream's own log.
    tables.add_reviews(score_reviews(df.where("review_id > 40")), f"{out}/state", version=2)
    assert rows_of(aggregate_from_state(read_version(spark, f"{out}/state"))) == rows_of(ranked)


def test_open_windows_are_written(spark, tmp_path):
    df, inbox, out = table(spark), str(tmp_path / "in"), str(tmp_path / "out")
    feed(df, inbox, ["review_id < 30", "review_id >= 30"])
    stats = stream.windowed_entities(score_reviews(source(spark, inbox)))
    tables.write_windows(stats, out, str(tmp_path / "state")).awaitTermination()
    whole = stream.windowed_entities(score_reviews(df))
    assert rows_of(tables.read_windows(spark, out)) == rows_of(whole)


@pytest.mark.parametrize("batch_size", (None, 2))
def test_flags_equal_the_batch_flag(spark, tmp_path, batch_size):
    df, inbox = table(spark), str(tmp_path / "in")
    feed(df, inbox, ["review_id < 25", "review_id between 25 and 40", "review_id > 40"])
    if batch_size:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_size)
    try:
        flags = stream.flag_repeats(source(spark, inbox), delay="400 days")
        found = run(flags, spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = mark_duplicates(df).select("review_id", "date", "fingerprint", "is_duplicate")
    assert rows_of(found) == rows_of(expected)


def run(flags, spark, tmp_path):
    out, state = str(tmp_path / "flags"), str(tmp_path / "flags-state")
    writer = flags.writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(flags.schema).parquet(out)


def test_flags_after_restart_late_rows_and_expiry(spark, tmp_path):
    inbox = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = "review_id bigint, feedback_text string, date timestamp"
    flags = stream.flag_repeats(source(spark, inbox, schema), delay="1 day")

    def add(*rows):
        df = spark.createDataFrame([(i, t, d) for i, t, d in rows], "review_id bigint, feedback_text string, d string")
        feed(df.select("review_id", "feedback_text", F.col("d").cast("timestamp").alias("date")), inbox, ["true"])
        return {r["review_id"]: r["is_duplicate"] for r in run(flags, spark, tmp_path).collect()}

    assert add((2, "Same text.", "2024-01-02 00:00:00"), (1, "same TEXT. ", "2024-01-02 01:00:00")) == {1: False, 2: True}
    # After a restart: the state is still known, and the first row delivered again is no duplicate of itself.
    assert add((3, "Same text.", "2024-01-02 12:00:00"))[3] is True
    assert add((4, "Other text.", "2024-01-10 00:00:00"))[4] is False
    # Behind the watermark (2024-01-09): left out.
    assert 5 not in add((5, "Other text.", "2024-01-08 00:00:00"))
    # The first text was last seen more than a day before the watermark: it is new again.
    assert add((6, "Same text.", "2024-01-10 01:00:00"))[6] is False
    assert add((7, "Other text.", "2024-01-10 02:00:00"))[7] is True


def test_flags_need_no_state_per_text(spark, tmp_path):
    """Many texts share few states: Python is called per group, not per text."""
    inbox = str(tmp_path / "in")
    rows = spark.range(3000).select(
        F.col("id").alias("review_id"), F.lit("t").alias("teacher_name"), F.lit("x").alias("subject"),
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("Text "), (F.col("id") * 7 % 2000).cast("string"))).alias("feedback_text"),
        F.lit("2024-01-01").cast("timestamp").alias("date"),
    )
    feed(rows, inbox, ["review_id < 1500", "review_id between 1500 and 2400", "review_id > 2400"])
    flags = stream.flag_repeats(source(spark, inbox), delay="400 days", groups=16)
    writer = flags.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16
    expected = mark_duplicates(rows).select("review_id", "date", "fingerprint", "is_duplicate")
    assert rows_of(spark.read.schema(flags.schema).parquet(str(tmp_path / "out"))) == rows_of(expected)
