from pyspark.sql import functions as F

from reviewlens.operators.score import score_reviews
from reviewlens.streaming import reviews as stream

SCHEMA = "review_id bigint, teacher_name string, feedback_text string, date timestamp"


def batches(spark, path):
    rows = [
        (1, "a", "Great clear lectures.", "2024-01-02 00:00:00"),
        (2, "a", "great clear LECTURES. ", "2024-01-02 05:00:00"),
        (3, "b", "Boring and late.", "2024-01-20 00:00:00"),
        (4, "b", "", "2024-03-20 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "review_id bigint, teacher_name string, feedback_text string, d string")
    df = df.withColumn("date", F.to_timestamp("d")).drop("d")
    for i in range(1, 5):
        df.where(F.col("review_id") == i).coalesce(1).write.mode("append").parquet(path)
    return df


def run(df, spark, tmp_path, name):
    out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
    df.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    table = batches(spark, source)
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    scored = run(stream.score_stream(live), spark, tmp_path, "scored")
    assert sorted(map(str, scored.collect())) == sorted(map(str, score_reviews(table).collect()))

    unique = run(stream.drop_repeats(live), spark, tmp_path, "unique")
    assert unique.count() == 2

    windows = run(stream.windowed_entities(stream.score_stream(live)), spark, tmp_path, "windows").collect()
    assert {(w["teacher_name"], w["total_reviews"]) for w in windows} == {("a", 2), ("b", 1)}
