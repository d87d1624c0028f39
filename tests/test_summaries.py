import random

import pytest
from pyspark.sql import functions as F

from reviewlens import constants as K
from reviewlens.functions import text as T
from reviewlens.operators import summary
from reviewlens.operators.keywords import extract_keywords
from reviewlens.operators.score import score_reviews
from reviewlens.plans.report import REPORT_COLUMNS, summary_report

FEW = ["Student A says my pace is slow.", "I liked the clear lectures.", "We had a fair exam."]
MANY = [
    "The lectures are clear and I loved the structure of it all.",
    "Assignments came with an excessive workload every single week.",
    "My favourite part was the calm and friendly way of teaching.",
    "Explains everything well, the pace is great. Exams were confusing though.",
    "Grading was late and my rubric was missing. Nothing else to say here.",
    "A student noted the deadline moved. The explanations stayed clear.",
]


def reviews(spark):
    rows = [(i, "few", t) for i, t in enumerate(FEW)] + [(10 + i, "many", t) for i, t in enumerate(MANY)]
    rows += [(30, "blank", "  "), (31, None, "nobody is meant by this.")]
    return spark.createDataFrame(rows, "review_id bigint, teacher_name string, feedback_text string")


def scores(spark):
    rows = [(n, 9.0, 6.8, 6.9, 6.9, 3.0) for n in ("few", "many", "blank", "none")]
    return spark.createDataFrame(rows, "teacher_name string, " + ", ".join(f"{c} double" for c in K.SCORE_COLUMNS))


def test_entity_summaries(spark):
    result = {r["teacher_name"]: r for r in summary.summarise_entities(reviews(spark), scores(spark), scale=10.0).collect()}
    assert result["none"]["summary"] == K.NO_COMMENTS_MESSAGE
    assert result["few"]["summary"] == (
        "Based on a limited sample of 3 reviews, feedback notes that: Feedback says the pace is slow. "
        "feedback appreciated the clear lectures. feedback had a fair exam."
    )
    assert result["many"]["summary"] == (
        "The lectures are clear and feedback appreciated the structure of it all. "
        "Assignments came with an excessive workload every single week. "
        "the favourite part was the calm and friendly way of teaching."
    )
    assert result["many"]["strengths"] == ["clear explanations", "clear assignment rubrics"]
    assert result["many"]["improvements"] == [
        "balance assignment workload", "improve grading consistency", "improve punctuality and responsiveness",
    ]
    assert all(len(r["summary"].split()) < 80 for r in result.values())


def test_cached_summaries_are_reused(spark):
    first = summary.refresh_summaries(reviews(spark), scores(spark), None)
    kept = first.withColumn("summary", F.lit("from the cache"))
    more = reviews(spark).union(spark.createDataFrame([(50, "few", "One more clear comment.")]))
    again = {r["teacher_name"]: r["summary"] for r in summary.refresh_summaries(more, scores(spark), kept).collect()}
    assert again["many"] == "from the cache"
    assert again["few"].startswith("Based on a limited sample of 4 reviews")


def test_content_key_ignores_order(spark):
    df = reviews(spark)
    keys = [sorted(map(str, summary.content_keys(df.repartition(n)).collect())) for n in (1, 4)]
    assert keys[0] == keys[1]


def test_group_summary_reads_all_comments(spark):
    rng = random.Random(5)
    rows = [(i, "g", "x" * rng.choice([1, 1, 2, 3, 5, 6, 20])) for i in range(5000)]
    rows += [(9000 + i, "g", f"Sentence number {i} comes late. Short.") for i in range(5)]
    rows += [(i, "words", "two words") for i in range(12)] + [(i, "none", "tiny text") for i in range(400)]
    rows += [(1, "blank", "  "), (2, "blank", None)]
    df = spark.createDataFrame(rows, "review_id bigint, g string, feedback_text string").repartition(5)
    found = {r["g"]: r["summary"] for r in summary.summarise_feedback(df, "g").collect()}
    assert found["g"] == " ".join(f"Sentence number {i} comes late." for i in range(3))
    assert found["words"] == " ".join(["two words"] * 12)
    assert found["none"] == " ".join(["tiny text"] * 400)[:300]
    assert found["blank"] == ""


def test_feedback_summary_edges(spark):
    df = reviews(spark)
    assert summary.summarise_feedback(df.limit(0)).first()["summary"] == K.NO_FEEDBACK_MESSAGE
    assert summary.summarise_feedback(df.where("teacher_name = 'blank'")).first()["summary"] == ""
    by_label = {r["sentiment_label"]: r["summary"] for r in summary.summarise_by_sentiment(score_reviews(df.limit(0))).collect()}
    assert by_label["Negative"] == "No negative feedback found."


def test_report(spark):
    scored = score_reviews(reviews(spark))
    report = summary_report(scored)
    assert tuple(report.columns) == REPORT_COLUMNS
    assert report.count() == 3
    off = summary_report(scored, run_summarizer=False).first()
    assert off["AI Summary"] == K.SUMMARY_DISABLED_MESSAGE and off["AI Strengths"] == ""
    assert summary_report(scored.limit(0), run_summarizer=False).count() == 0


def test_executive_summary(spark):
    entities = spark.createDataFrame(
        [("many", 7.2, "B", "Good", 50.0, 25.0, 25.0, 9.0, 6.8, 6.9, 6.9, 3.0)],
        "teacher_name string, overall_score double, grade string, descriptor string, positive_pct double, neutral_pct double, "
        "negative_pct double, " + ", ".join(f"{c} double" for c in K.SCORE_COLUMNS),
    )
    texts = spark.createDataFrame([("many", "All fine.")], "teacher_name string, summary string")
    report = summary.executive_summary(entities, texts).first()["report"]
    assert "EXECUTIVE SUMMARY — MANY" in report and "72.0 / 100" in report
    assert "Communication (9.0), Engagement (6.9), Responsiveness (6.9)" in report
    assert "Assignment Quality (3.0), Subject Knowledge (6.8)" in report


def test_keywords(spark):
    df = spark.createDataFrame([("The fun labs, fun Labs and café work9 work",), (None,)], "feedback_text string")
    words = [(r["word"], r["count"]) for r in extract_keywords(df).collect()]
    assert words == [("labs", 2), ("work", 1)]


def test_scaled_scores(spark):
    large = scores(spark).select("teacher_name", *[(F.col(c) * 10).alias(c) for c in K.SCORE_COLUMNS])
    a = summary.summarise_entities(reviews(spark), scores(spark), scale=10.0)
    b = summary.summarise_entities(reviews(spark), large)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_sentences_are_rewritten_one_by_one(spark):
    """The same sentences as of the rewritten text, and no rewriting of sentences without such wording."""
    rng = random.Random(5)
    words = ["I", "i", "ı", "my", "MY", "me", "for", "For", "we", "We", "in", "opinion", "Student", "students", "one", "some", "B", "says", "feel",
             "would", "like", "li\u212ae", "loved", "the", "exams", "ſtudent", "Iris", "am_I", "myé"]
    joints = [" ", " ", " ", "  ", "\n", ". ", "! ", "?", ".", "...\u2003", ", "]
    texts = ["".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["Good.For me it is fine!for me? For me. Yes", "for me", "", "  . I. ", "Fine.For me not bad at all."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole, single = T.sentences(T.anonymise(F.col("t")), 3), T.anonymous_sentences(F.col("t"), 3)
    plain = F.col("t")
    for about in (True, False):
        for pattern, replacement in T.ANONYMOUS_PATTERNS:
            if ("tudent" in pattern) == about:
                plain = F.regexp_replace(plain, T._whole_words(pattern), replacement)
    for row in df.select("t", whole.alias("w"), single.alias("s"), T.anonymise(F.col("t")).alias("a"), T.text_trim(plain).alias("p")).collect():
        assert row["s"] == row["w"] and row["a"] == row["p"], row["t"]


def test_summaries_rewrite_no_whole_comments(spark, monkeypatch):
    """Comments of entities with enough of them are split before anything in them is replaced."""
    calls = []
    monkeypatch.setattr(summary.T, "anonymous_sentences", lambda *a, f=T.anonymous_sentences: calls.append(a) or f(*a))
    rows = {r["teacher_name"]: r["summary"] for r in summary.summarise_entities(reviews(spark), scores(spark), scale=10.0).collect()}
    assert calls and rows["many"].startswith("The lectures are clear and feedback appreciated")


def test_known_summaries_are_computed_once(spark):
    """A cache that is still to be computed is not computed once per use."""
    first = summary.refresh_summaries(reviews(spark), scores(spark), None, scale=10.0)
    stored = spark.createDataFrame(first.collect(), first.schema)
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda key: (seen.add(1), key)[1]).asNondeterministic()
    cache = stored.withColumn("content_key", counted("content_key"))
    again = summary.refresh_summaries(reviews(spark), scores(spark), cache, scale=10.0)
    assert sorted(map(str, again.select(*first.columns).collect())) == sorted(map(str, stored.collect()))
    assert seen.value == stored.count()
