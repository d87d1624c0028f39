import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.config import AggregationConfig
from reviewlens.operators import cohort, skew
from reviewlens.operators import entity as entity_module
from reviewlens.operators.entity import (
    aggregate, aggregate_from_scores, entity_report, rank_entities, summarise_groups, unpivot_aspects,
)
from reviewlens.operators.trend import trend

SCHEMA = (
    "review_id bigint, teacher_name string, subject string, communication_score double, subject_knowledge_score double, "
    "engagement_score double, responsiveness_score double, assignment_quality_score double, confidence double, "
    "sentiment_label string, is_mixed boolean, strengths_list array<string>, improvements_list array<string>"
)


def scored(spark, entities=3, each=10, seed=1):
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        for _ in range(each):
            scores = [round(rng.uniform(3, 9.5), 2) for _ in range(5)]
            labels = rng.sample(["a", "b", "c", "d", "e", "f"], rng.randint(0, 3))
            rows.append(
                (len(rows), f"T{e}", rng.choice(["Math", "Art"]), *scores, round(rng.uniform(0.55, 0.95), 4),
                 rng.choice(K.SENTIMENTS), rng.random() < 0.3, labels, labels[::-1])
            )
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_invariants(spark):
    df = scored(spark, 5, 12)
    rows = aggregate_from_scores(df).collect()
    assert len(rows) == 5
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    ordered = sorted(rows, key=lambda r: r["rank"])
    assert [r["overall_score"] for r in ordered] == sorted((r["overall_score"] for r in rows), reverse=True)
    for r in rows:
        assert r["total_reviews"] == 12
        assert all(0 <= r[c] <= 10 for c in K.SCORE_COLUMNS) and 0 <= r["confidence_score"] <= 1
        assert abs(r["positive_pct"] + r["neutral_pct"] + r["negative_pct"] - 100) <= 0.5
    for c in K.SCORE_COLUMNS:
        assert max(r[c] for r in rows) == 10 and min(r[c] for r in rows) == 0


def test_two_entities_by_hand(spark):
    rows = []
    for i in range(5):
        rows.append((i, "X", 9.0 - i * 0.1, 0.9, "Positive", False, ["clear explanations"], []))
        rows.append((9 - i, "Y", 5.0 + i * 0.1, 0.642, "Neutral" if i < 2 else "Negative", True, [], ["improve engagement"]))
    df = spark.createDataFrame(
        rows, "review_id bigint, teacher_name string, communication_score double, confidence double, "
        "sentiment_label string, is_mixed boolean, strengths_list array<string>, improvements_list array<string>"
    )
    x, y = aggregate_from_scores(df).orderBy("rank").collect()
    assert (x["teacher_name"], x["communication_score"], y["communication_score"]) == ("X", 10.0, 0.0)
    assert (x["engagement_score"], y["engagement_score"]) == (5.0, 5.0)  # filled, constant, so unchanged
    assert (x["overall_score"], x["grade"], y["overall_score"], y["grade"]) == (6.25, "C", 3.75, "F")
    assert (x["confidence_score"], y["confidence_score"]) == (0.72, 0.5136)
    assert (x["confidence_band"], y["confidence_band"]) == ("Medium", "Medium")
    assert (y["neutral_pct"], y["negative_pct"], y["mixed_count"]) == (40.0, 60.0, 5)
    assert (x["strengths"], y["strengths"], y["improvements"]) == ("clear explanations", "", "improve engagement")


def test_defaults_empty_and_weights(spark):
    one = spark.createDataFrame([(0.0,), (10.0,)], "communication_score double")
    row = aggregate_from_scores(one).first()
    assert (row["teacher_name"], row["communication_score"], row["confidence_score"]) == (K.DEFAULT_ENTITY, 5.0, 0.34)
    assert aggregate_from_scores(one.limit(0)).count() == 0
    assert cohort.cohort_summary(aggregate_from_scores(one.limit(0))).count() == 0
    with pytest.raises(ValueError):
        aggregate(one.withColumn("feedback_text", F.lit("x")), AggregationConfig(weights={**K.ENTITY_WEIGHTS, "Engagement": 0.5}))


def test_top_labels_equal_a_counter(spark):
    df = scored(spark, 4, 15, seed=7)
    expected = {}
    for row in sorted(df.collect(), key=lambda r: r["review_id"]):
        expected.setdefault(row["teacher_name"], Counter()).update(row["strengths_list"])
    for row in summarise_groups(df, "teacher_name", []).collect():
        assert row["strengths"] == [label for label, _ in expected[row["teacher_name"]].most_common(5)]


def test_result_does_not_depend_on_partitions(spark):
    df = scored(spark, 6, 20, seed=3)
    results = [sorted(map(str, aggregate_from_scores(df.repartition(n)).collect())) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]


def test_range_rank_equals_window_rank(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("teacher"), (F.col("id") % 7).cast("double").alias("score"))
    plain = sorted(map(str, rank_entities(df).collect()))
    monkeypatch.setattr(skew, "SINGLE_TASK_ROWS", 10)
    assert sorted(map(str, rank_entities(df).collect())) == plain


def test_lookup_join_paths_agree(spark, monkeypatch):
    # One key has a third of all rows, some rows have no key or an unknown one.
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )
    right = left.where("key is not null and key <> 'k5'").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    expected = sorted(map(str, left.join(right.drop("n"), "key", "left").select("id", "key", "first").collect()))
    for rows in (100_000, 3):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
        for hot in (2, 2000):
            monkeypatch.setattr(skew, "HOT_KEYS", hot)
            joined = skew.lookup_join(left, right, "key", "n", F.col("id")).select("id", "key", "first")
            assert sorted(map(str, joined.collect())) == expected


def test_first_per_group_with_large_limits(spark):
    df = spark.range(9000).select("id", (F.col("id") % 2).alias("g"))
    for most in (5, 1750):
        kept = skew.first_per_group(df, ["g"], [F.col("id")], most, "id").collect()
        assert sorted(r["id"] for r in kept) == list(range(2 * most))


def test_cohort_summary(spark):
    entities = aggregate_from_scores(scored(spark, 4, 11))
    rows = entities.collect()
    row = cohort.cohort_summary(entities).first()
    top = min(rows, key=lambda r: r["rank"])
    assert (row["n_teachers"], row["total_reviews"], row["top_teacher"]) == (4, 44, top["teacher_name"])
    assert row["grade_distribution"] == dict(Counter(r["grade"] for r in rows))
    single = cohort.cohort_summary(aggregate_from_scores(scored(spark, 1, 4))).first()
    assert single["std_overall"] is None


def test_unpivot_and_lookup(spark):
    entities = aggregate_from_scores(scored(spark, 3, 4))
    assert unpivot_aspects(entities).count() == 15
    assert entity_report(entities, "T1").count() == 1 and entity_report(entities, "nobody").count() == 0


def test_trend_fills_gaps(spark):
    df = spark.createDataFrame(
        [("2024-01-03", 4.0), ("2024-01-30", 5.0), ("2024-04-01", 7.0), ("2024-02-02", None), (None, 1.0)], "d string, s double"
    )
    df = df.withColumn("d", F.to_date("d"))

    def run(frequency):
        return [(str(r["date"]), r["mean_score"], r["count"]) for r in trend(df, "d", "s", frequency).orderBy("date").collect()]

    assert run("ME") == [("2024-01-31", 4.5, 2), ("2024-02-29", None, 0), ("2024-03-31", None, 0), ("2024-04-30", 7.0, 1)]
    assert run("QE") == [("2024-03-31", 4.5, 2), ("2024-06-30", 7.0, 1)]
    assert run("YE") == [("2024-12-31", 5.33, 3)]
    weeks = run("W")
    assert weeks[0] == ("2024-01-07", 4.0, 1) and weeks[-1] == ("2024-04-07", 7.0, 1) and len(weeks) == 14
    assert len(run("D")) == 90
    with pytest.raises(ValueError):
        trend(df, "d", "s", "H")


def test_bins_and_key_figures(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (100.0,), (100.1,), (-1.0,)], "x double")
    counts = [r["count"] for r in cohort.score_bins(df, "x").orderBy("bin").collect()]
    assert counts == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    rows = scored(spark, 3, 6)
    figures = cohort.key_figures(rows, aggregate_from_scores(rows)).first()
    assert figures["total_reviews"] == 18 and 0 <= figures["overall_score"] <= 100


def test_entity_score_without_rows(spark):
    empty = spark.createDataFrame([], "polarity double, sentiment_label string")
    row = cohort.entity_score(empty, by=None, use_aspects=False).first()
    assert (row["overall_score"], row["grade"], row["descriptor"]) == (0.0, "N/A", "No data")


def test_labels_do_not_depend_on_row_order(spark):
    rows = [("e", ["b", "a"]), ("e", ["a", "c"]), ("e", ["c", "b"])]
    df = spark.createDataFrame(rows, "teacher_name string, strengths_list array<string>")
    found = {str(entity_module.summarise_groups(df.repartition(n), "teacher_name", []).first()["strengths"]) for n in (1, 2, 3)}
    assert found == {"['a', 'b', 'c']"}


def test_large_scores_are_summed(spark):
    df = spark.createDataFrame([("e", 3e12)] * 8, "teacher_name string, x double")
    assert entity_module.summarise_groups(df, "teacher_name", ["x"]).first()["mean_x"] == 3e12


def test_hot_group_sends_few_rows(spark):
    """One group with nine tenths of all rows: every task limits its own part before the first exchange."""
    df = spark.range(0, 20_000, 1, 16).select("id", F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("g"))
    limited = skew.first_per_group(df, ["g"], [F.col("id")], 4, "id")
    plan = limited._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange"):]
    assert "WindowGroupLimit" in first and "_task" in first and "Partial" in first
    assert limited.where("g = 0").count() == 4
